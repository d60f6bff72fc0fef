"""Ranked search, page extraction and phrase mining against brute force and DuckDB."""

import html as H
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from bidscope.llm import collocations as C
from bidscope.llm import html_text as X
from bidscope.llm import lexical_search as L
from bidscope.llm import queries as Q
from bidscope.llm.common import table
from conftest import SF001
from llm.conftest import DOCS

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k):
    """Every item against every document, term by term."""
    terms = [(i, TERM.findall((t or "").translate(ASCII_LOWER))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    out = []
    for item, text in set(items):
        rows = []
        for i, ts in terms:
            tf = Counter(ts)
            if ts:
                m = 100 - 25 + (25 * len(ts) * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[q] + 1))) * ((10 ** 9 * tf[q]) // (1000 * tf[q] + 12 * m))
                        for q in TERM.findall((text or "").translate(ASCII_LOWER)) if tf[q])
                if s > 0:
                    rows.append((-s, i is None, i or 0, i))
        out += [(item, at + 1, i, -s) for at, (s, _, _, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, edge_docs, monkeypatch):
    items = [(1, "the cat sat the shared1 shared2 w5 w6 w7"), (2, None), (3, ""), (4, "Zürich SCHÖN É see"), (5, "unheard of"), (1, "a b c d"), (5, "unheard of"), (None, "漢字 tail x"),
             (9, " ".join(f"w{k}" for k in range(900)))]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' AS score", "1 AS rank")
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    for k, block in ((3, 2000), (20, 2)):
        monkeypatch.setattr(L, "BLOCK_ITEMS", block)
        got = sorted((tuple(r) for r in L.rank_documents(edge_docs, asked, k=k).collect()), key=str)
        assert got == search(docs, items, k)


def test_many_copies_and_ties(spark):
    """Classes larger than k, in several partitions, and classes of equal score."""
    r = random.Random(3)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(25)]
    docs = [(i, texts[r.randrange(25)] if r.random() < 0.6 else "a b") for i in range(600)]
    r.shuffle(docs)
    items = [(i, " ".join(r.choice("abcdef") for _ in range(4))) for i in range(12)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).repartition(7)
    got = L.rank_documents(df, spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert sorted(map(tuple, got.collect()), key=str) == search(docs, items, 20)


def test_search_edges(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.rank_documents(no_docs, items).count() == 0
    assert L.rank_documents(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS), items).count() == 0
    assert L.rank_documents(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS), items.where("false")).count() == 0


def test_large_sums_stay_exact():
    block = L.ItemBlock([(1, Counter({b"a": 1 << 26, b"b": 3})), (2, Counter({b"b": 1}))]).with_weights(10 ** 9, {0: 1, 1: 5})
    m, tf = np.array([75, 900]), np.array([7, 5, 11])
    got = block.scores(np.array([0, 1, 1]), np.array([0, 0, 1]), tf, m, 2)
    part = [int(block.weight[t]) * ((10 ** 9 * int(f)) // (1000 * int(f) + 12 * int(x))) for t, f, x in ((0, 7, 75), (0, 5, 900), (1, 11, 900))]
    assert got.tolist() == [[part[0] << 26, 0], [(part[1] << 26) + 3 * part[2], part[2]]]


def test_packed_numbers():
    r = np.random.default_rng(1)
    v = np.concatenate([[0, 127, 128, 16383, 16384, 2 ** 32 - 1], r.integers(0, 2 ** 32, 500), r.integers(0, 200, 500)])
    assert (L.unpack(L.pack(v)[0]) == v).all() and len(L.unpack(b"")) == 0


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op13_phrase_collocations"])
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF001)
    want = con.sql(Q.SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and got.count() > 0


def mine(docs, max_words, min_count, covered, top):
    """All phrases of all lengths, one after the other."""
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                f[lang if lang is not None else "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        cand = {p: c for p, c in counts.items() if len(p) > 1 and c >= min_count}
        most = Counter()
        for p, c in cand.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                most[sub] = max(most[sub], c)
        rows = []
        for p, a in cand.items():
            if 100 * most[p] >= covered * a and most[p]:
                continue
            s, _, lft, rgt = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), a, lft, rgt))
        out += [(lang, at + 1, p.decode(), a, lft, rgt, n, -s) for at, (s, _, p, a, lft, rgt) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs(n=400, seed=4):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "straße", "Äpfel", "漢字", "a", "b\x1cc", " "]
    return [(r.choice(["en", "de", None, ""]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n"]) for _ in range(r.randint(0, 40)))) for _ in range(n)] + [("en", None), ("fr", " . "), ("en", "new york city " * 30)]


@pytest.mark.parametrize("max_words,min_count,covered,top", [(3, 10, 50, 2000), (3, 3, 80, 5), (2, 5, 50, 2000), (5, 4, 50, 2000)])
def test_phrases_equal_brute_force(spark, max_words, min_count, covered, top):
    docs = phrase_docs()
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, t) in enumerate(docs)], DOCS).selectExpr("*", "1 AS phrase", "2 AS n", "3 AS w1").repartition(5)
    got = C.collocations(df, max_words=max_words, min_count=min_count, covered_percent=covered, top=top)
    assert sorted(map(tuple, got.collect())) == mine(docs, max_words, min_count, covered, top)


def test_windows_go_on_over_cuts(monkeypatch):
    """The same pairs and windows whatever the size of the parts."""
    docs = phrase_docs(60, 9)
    batch = pa.RecordBatch.from_pydict({"lang": [lang or "x" for lang, _ in docs], "text": [t for _, t in docs]})

    def seen(reach):
        out = Counter()
        for lang, codes, words, n in C.word_codes(batch, reach):
            w = [None if c < 0 else words[c].as_py() for c in codes.tolist()]
            out.update((lang, *w[i:i + reach + 1]) for i in range(n) if w[i] is not None)
        return Counter({k: v for k, v in out.items() if None not in k and len(k) == reach + 2})

    whole = {reach: seen(reach) for reach in (1, 2, 4)}
    for size in (1, 7, 50, 300):
        monkeypatch.setattr(C, "PART_BYTES", size)
        assert {reach: seen(reach) for reach in (1, 2, 4)} == whole


def test_phrase_scores_past_64_bits(spark):
    """Counts whose products pass 64 bits, through the same expressions as the query."""
    a, l, r = 3_000_000_000, 4_000_000_001, 5_000_000_003
    got = spark.sql(f"SELECT (1000000 * cast({a}L as decimal(19, 0)) * cast({a}L as decimal(19, 0))) div (cast({l}L as decimal(19, 0)) * cast({r}L as decimal(19, 0))) AS s").first().s
    assert got == 10 ** 6 * a * a // (l * r)


def test_phrase_edges(spark, edge_docs, no_docs):
    assert C.collocations(no_docs).count() == 0
    rows = C.collocations(edge_docs, min_count=2, top=10 ** 6).collect()
    docs = [(r.lang, r.text) for r in edge_docs.select("lang", "text").collect()]
    assert sorted(map(tuple, rows)) == mine(docs, 3, 2, 50, 10 ** 6)
    with pytest.raises(ValueError):
        C.collocations(no_docs, max_words=1)


def test_pages_equal_their_documents(spark):
    """The pages' articles hold texts of the documents: the heading and then the document's lines."""
    lines = {tuple(" ".join(x.split()) for x in r.text.split("\n") if x.strip()) for r in table(spark, SF001, "documents").where("text is not null").collect()}
    pages = {r.page_id: r.html for r in table(spark, SF001, "pages").collect()}
    rows = Q.QUERIES["op12_html_extraction"](spark, SF001).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        head, *rest = r.text.split("\n")
        source = pages[r.page_id]
        assert tuple(rest) in lines and r.n_chars == len(r.text)
        assert head == " ".join(H.unescape(source[source.index("<h1>") + 4:source.index("</h1>")]).split())


P = "<p>" + "Some words of the long paragraph that makes up the article, and more of them. " * 3 + "</p>"
WORDS = X.main_text(P)
CASES = {
    "<div class='top-nav'><a href=/>a</a> <a href=/b>b</a></div><div id=main><h1>T</h1>" + P + "<p>short.</p></div><div id=comments>" + P * 3 + "</div><div class='site-footer'>(c)</div>": f"T\n{WORDS}\nshort.",
    f"<html><body><header>Site</header><div class=wrap><div class=text>{P}{P}</div><div class=right-sidebar>{P}</div></div><form><p>Mail <input></form><aside>x</aside></body></html>": f"{WORDS}\n{WORDS}",
    f"<article><header><h1>A &amp; B</h1></header>{P}<ul><li>one<li>two &lt;b&gt;</ul><div class=share><a>x</a></div><p>x&nbsp;&#8212;<b>bold</b><br>y</article>": f"A & B\n{WORDS}\none\ntwo <b>\nx —bold y",
    f"<form id=aspnet>{P}{P}<input type=hidden></form>": f"{WORDS}\n{WORDS}",
    f"<main><p><b>open<br>{P}<table><tr><td>c1<td>c2<tr><td>d1</table></main>": f"open\n{WORDS}\nc1\nc2\nd1",
    f"<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><article>{P}<script>x</script><p title='a > b'>z</p></article><div role=contentinfo>{P}</div>": f"{WORDS}\nz",
    f"<article><p>teaser</p></article><div class=body>{P}{P}{P}</div>": f"{WORDS}\n{WORDS}\n{WORDS}",
    f"<article>{P}<section class=comments>{P}{P}{P}</section></article>": WORDS,
    "plain  text\n only": "plain text only", "": "", "<p></p>": "", "<html><head><title>t</title></head></html>": "", "a < b <": "a < b <", "<p>x": "x", "&copy 1 &#x41;&bogus;": "© 1 A&bogus;",
}


@pytest.mark.parametrize("html", CASES)
def test_main_text(html):
    assert X.main_text(html) == CASES[html]


def test_long_and_odd_pages():
    deep = "<div>" * 3000 + P + "</div>" * 3000
    assert X.main_text(deep) == WORDS
    many = "".join(f"<p>line {k} of a very long page</p>" for k in range(20_000))
    assert X.main_text(f"<body><nav><a href=/>x</a></nav>{many}</body>").split("\n") == [f"line {k} of a very long page" for k in range(20_000)]
    r = random.Random(2)
    bits = ["<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "</table>", "<div class='ad'>", "</div>", "<h1>", "</h2>", "<", ">", "&", "&lt;", "\"", "'", "<!--", "-->", "<script>", "</script>", "text ", "\x00"]
    for _ in range(400):
        X.main_text("".join(r.choice(bits) for _ in range(r.randint(0, 60))))


def test_extraction_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, "u", ""), (None, None, "<p>x</p>")], "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "'clash' AS block")
    assert sorted(map(tuple, X.extract_text(df).select("page_id", "text", "n_chars", "block").collect()), key=str) == sorted([(1, "", 0, "clash"), (1, "", 0, "clash"), (2, "", 0, "clash"), (None, "x", 1, "clash")], key=str)
    assert X.extract_text(df.limit(0)).count() == 0
