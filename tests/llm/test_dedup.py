"""Substring, line, SimHash and embedding dedup and spot signatures against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from bidscope.llm import embedding_join as EJ
from bidscope.llm import line_dedup as L
from bidscope.llm import queries as Q
from bidscope.llm import simhash_join as H
from bidscope.llm import spot_signatures as S
from bidscope.llm import substring_dedup as D
from bidscope.llm.common import components, table
from conftest import SF001
from llm.conftest import components_of


def plain_substrings(rows, window):
    """(words, removed, kept) by (id, text), with all windows in one table."""
    words = {(i, t): (t or "").encode().split() for i, t in rows}
    first = {}
    for i, t in sorted((k for k in words if k[0] is not None), key=lambda k: k[0]):
        w = words[i, t]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for (i, t), w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out[i, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_op3_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    want = {i: v for (i, _), v in plain_substrings(docs, 13).items()}
    for r in Q.QUERIES["op3_substring_dedup"](spark, SF001).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_substrings_of_small_alphabets(spark, window, monkeypatch):
    """Runs, periods and chance repeats, with documents cut into parts."""
    r = random.Random(window)
    texts = [" ".join(r.choice("ab" if i % 3 else "abcdefgh") for _ in range(r.randint(0, 60))) for i in range(60)] + ["a " * 100, "b " + "a " * 50, "a b " * 40, "a b " * 40]
    rows = list(enumerate(texts))
    got = D.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    want = plain_substrings(rows, window)
    for g in got:
        assert (g.n_words, g.n_removed, g.kept_words) == want[g.doc_id, g.text]


def test_symbols_do_not_depend_on_what_surrounds_a_window():
    r = np.random.default_rng(3)
    for case in range(40):
        core = r.integers(0, 3 if case % 2 else 50, 40).astype(np.uint64)
        seen = []
        for _ in range(3):
            before, after = r.integers(0, 50, r.integers(0, 9)), r.integers(0, 50, r.integers(0, 9))
            names = D.mix(np.concatenate([before, core, after]).astype(np.uint64))
            g = D.window_groups(names, np.array([0, len(names)]), 13)
            at = {int(f) + k: int(x) for f, n, x in zip(g["first"], g["n"], g["key"]) for k in range(n)}
            seen.append([at[len(before) + k] for k in range(28)])
        assert seen[0] == seen[1] == seen[2]


def test_long_documents_are_cut_into_parts(spark, monkeypatch):
    names = D.mix(np.arange(500, dtype=np.uint64) % np.uint64(190))
    whole = D.window_groups(names, np.array([0, 500]), 13)
    at = {int(f) + k: x for f, n, x in zip(whole["first"], whole["n"], whole["key"]) for k in range(n)}
    for cut in (100, 250):
        part = D.window_groups(names[cut:cut + 112], np.array([0, 112]), 13)
        for f, n, x in zip(part["first"], part["n"], part["key"]):
            assert all(at[cut + int(f) + k] == x for k in range(n))


def test_substring_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = plain_substrings(rows, 13)
    got = D.dedup_substrings(edge_docs, window=13).collect()
    assert sorted(map(str, ((g.doc_id, g.text) for g in got))) == sorted(map(str, rows))
    for g in got:
        assert (g.n_words, g.n_removed, g.kept_words) == want[g.doc_id, g.text] and g["_id"] == "clash"
        assert re.findall(r"[^\x20\x09-\x0D]+", g.kept_text) == re.findall(r"[^\x20\x09-\x0D]+", g.kept_words)
        assert g.n_removed or g.kept_text == (g.text or "")
    assert D.dedup_substrings(no_docs).count() == 0


def plain_lines(rows, ratio, least):
    """(lines, dropped, text) of rows (host, text)."""
    pages, holds = {}, {}
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    for host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {trim(x) for x in (text or "").split("\n")} - {""}:
            holds[host, line] = holds.get((host, line), 0) + 1
    drop = {k for k, n in holds.items() if n >= least and n / pages[k[0]] > ratio}
    out = []
    for host, text in rows:
        if text is None:
            out.append((0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (host, trim(x)) not in drop]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark, edge_docs, no_docs):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), r.choice([None, "", "\n".join(r.choice(["menu", " menu ", "foot", ""] * 4 + [f"own {k}" for k in range(24)]) for _ in range(r.randint(1, 6)))])) for _ in range(200)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, source string, text string")
    got = sorted(L.dedup_lines(df, ratio=0.1, min_pages=5).collect(), key=lambda x: x.doc_id)
    want = plain_lines(rows, 0.1, 5)
    assert [(g.n_lines, g.n_dropped, g.text) for g in got] == want and sum(x[1] for x in want) > 30
    edge = L.dedup_lines(edge_docs).collect()
    assert len(edge) == edge_docs.count() and edge[0]["_host"] == "clash" and L.dedup_lines(no_docs).count() == 0


def test_line_dedup_runs_no_python_code(spark):
    plan = Q.QUERIES["op7_line_dedup"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_simhash(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op10_query(spark):
    docs = table(spark, SF001, "documents").collect()
    prints = {r.doc_id: plain_simhash(r.text, 4) for r in docs}
    want = components_of(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for r in Q.QUERIES["op10_simhash_near_dedup"](spark, SF001).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


def test_close_links_connect_all_that_is_close(spark):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(120)} | {r.getrandbits(64) for _ in range(200)})
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    links = H.close_links(spark.createDataFrame(signed, "node long, fingerprint long"), 4).collect()
    assert all((prints[x.src] ^ prints[x.dst]).bit_count() <= 4 for x in links)
    near = {i: {j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4} for i in range(len(prints))}
    want = components_of(list(near), lambda a, b: b in near[a])
    pairs = {(x.src, x.dst) for x in links} | {(x.dst, x.src) for x in links}
    assert components_of(list(near), lambda a, b: (a, b) in pairs) == want


def test_simhash_edges(spark, edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    nodes = {(r.doc_id, r.text): plain_simhash(r.text, 4) for r in rows if r.doc_id is not None}
    keys = sorted(nodes, key=lambda k: (k[0], k[1] or ""))
    close = lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 4 or a[0] == b[0]
    ids, seen = {}, set()
    for k in keys:
        if k in seen:
            continue
        group, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in keys if y not in group and close(x, y)]
        seen |= group
        ids |= {x[0]: min(g[0] for g in group) for x in group}
    got = H.simhash_components(edge_docs).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            assert g.component_id == ids[g.doc_id]
    assert H.simhash_components(no_docs).count() == 0


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400, 400 + k) for k in range(1, 60)] + [(600 + k, 601 + k) for k in range(50)] + [(7, 7)]
    both = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    want = components_of(nodes, lambda a, b: (a, b) in both)
    got = components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(nodes)


def test_embedding_components(spark):
    g = np.random.default_rng(8)
    rows, vectors = [], {}
    for c in range(12):
        centre = g.standard_normal(20)
        for k in range(15):
            v = centre + g.standard_normal(20) * g.choice([0, 0.1, 0.2, 0.35])
            rows.append((len(rows), v.astype(np.float32).tolist()))
    rows += [(len(rows) + k, (rng := g.standard_normal(20)).astype(np.float32).tolist()) for k in range(60)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 20), (n + 3, [float("nan")] + [1.0] * 19), (n + 4, [None] + [1.0] * 19), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, [float("inf")] * 20), rows[3]]
    for i, v in rows[:n] + rows[n + 5:n + 7]:
        vectors[i] = np.array(v, dtype=float)

    def linked(a, b):
        if a not in vectors or b not in vectors or len(vectors[a]) != len(vectors[b]):
            return False
        return vectors[a] @ vectors[b] / (np.linalg.norm(vectors[a]) * np.linalg.norm(vectors[b])) >= 0.95

    ids = sorted({i for i, _ in rows})
    want = components_of(ids, linked)
    got = EJ.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    for r in got:
        links = 0 if r.vec_id not in vectors else sum(linked(r.vec_id, j) for j, _ in rows) - 1
        assert (r.n_links, r.component_id, r.kept) == (links, want[r.vec_id], r.vec_id == want[r.vec_id])
    assert EJ.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_wanted_pair_is_within_budget_in_two_blocks():
    g = np.random.default_rng(1)
    for dim in (5, 8, 17, 64):
        spans, r2 = EJ.block_spans(dim), EJ.budgets(dim, 0.1)
        for _ in range(300):
            d = g.standard_normal(dim) * g.choice([0.01, 1, 5], dim)
            d *= np.sqrt(0.1) / np.linalg.norm(d)
            assert sum((d[a:b] ** 2).sum() <= r for (a, b), r in zip(spans, r2)) >= min(EJ.AGREE, len(spans))


def test_op9_query(spark, tmp_path):
    """The table's vectors with planted near copies, chains and odd vectors, against all pairs."""
    r = np.random.default_rng(6)
    rows = [(x.vec_id, x.embedding, x.label) for x in table(spark, SF001, "embeddings").collect()]
    made = []
    for k, (_, v, label) in enumerate(rows[:60]):
        v = np.array(v)
        for near in (0.02, 0.2, 0.31, 0.34):  # cosines on both sides of 0.95
            step = r.normal(size=len(v))
            made.append((v + near * np.linalg.norm(v) / np.linalg.norm(step) * step) * r.uniform(0.1, 9))
        made += [v, made[-3] + 0.1 * made[-4]]
    rows += [(100_000 + k, [float(x) for x in v], k % 7) for k, v in enumerate(made)]
    rows += [(200_000, None, 1), (200_001, [0.0] * len(rows[0][1]), 1), (200_002, [float("nan")] * len(rows[0][1]), None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in Q.QUERIES["op9_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    ids = [i for i, v, _ in rows if v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v for i, v, _ in rows if i in set(ids)], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cosine = x @ x.T
    linked = cosine >= 0.95
    assert np.abs(cosine - 0.95).min() > 1e-9 and linked.sum() > len(ids) + 200
    at = {i: k for k, i in enumerate(ids)}
    parts = components_of(ids, lambda a, b: linked[at[a], at[b]])
    want = {i: (int(linked[at[i]].sum()) - 1, parts[i], parts[i] == i) for i in ids} | {i: (0, i, True) for i in (200_000, 200_001, 200_002)}
    assert got == want


def test_op8_query(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in table(spark, SF001, "documents").collect()))
    got = {r.doc_id: r for r in Q.QUERIES["op8_document_fingerprints"](spark, SF001).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (S.digest(S.signatures(t)), S.digest(S.signatures(edited)))
        assert r.near_edited == S.text_likeness(t, S.spots(t), edited, S.spots(edited)) and r.near_next == S.text_likeness(t, S.spots(t), after, S.spots(after))


def test_spot_signatures_by_hand():
    assert S.spots("The quick fox of a red house") == S._hashed({"the quick fox", "of red house", "a red house"})
    assert S.signatures("") == S.signatures(None) == frozenset() and S.likeness(frozenset(), frozenset()) == 1.0


def test_fingerprint_chain_edges(spark, edge_docs, no_docs):
    got = S.fingerprint_chain(edge_docs).collect()
    assert len(got) == edge_docs.count() and all((g.near_next is None) == (g.doc_id is None) for g in got)
    assert S.fingerprint_chain(no_docs).count() == 0
    one = S.fingerprint_chain(spark.createDataFrame([(5, "the old man and the sea")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_alike_sets(spark, threshold):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "a"] * 12
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 120))) for _ in range(25)]
    texts = base + [" ".join(w for w in t.split() if r.random() > 0.03) for t in base] + base[:3] + [None, ""]
    members, pairs = S.alike_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold)
    sets = {i: S.signatures(t) for i, t in enumerate(texts)}
    classes = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {m.id: m.class_id for m in members.collect()} == classes
    reps = sorted(set(classes.values()))
    want = {(a, b): S.likeness(sets[a], sets[b]) for a in reps for b in reps if a < b and S.likeness(sets[a], sets[b]) >= threshold}
    assert {(p.a, p.b): p.likeness for p in pairs.collect()} == want


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_alike_sets_near_the_limit_of_spots(spark, threshold):
    """Texts with few spots and texts with enough of them, against text_likeness of every pair."""
    r = random.Random(3)
    texts = []
    for _ in range(12):
        words = [w for k in range(S.FEW_SPOTS) for w in (r.choice(["the", "of", "a"]), f"w{r.randint(0, 400)}", *(f"v{r.randint(0, 900)}" for _ in range(r.randint(0, 3))))]
        texts += [" ".join(words), " ".join(words[:-8]), " ".join(words[2:]), " ".join(words) + " " + " ".join(words[:4]) + " more"]
        texts.append(" ".join(f"p{k} p{k}" for k in range(3)) + " " + " ".join(words))
    found = [S.spots(t) for t in texts]
    sets = [S.signatures(t) for t in texts]
    classes = [min(j for j in range(len(texts)) if sets[j] == s) for s in sets]
    want, mixed = {}, 0
    for i in range(len(texts)):
        for j in range(len(texts)):
            alike = S.text_likeness(texts[i], found[i], texts[j], found[j])
            if classes[i] < classes[j] and alike >= threshold:
                key = (classes[i], classes[j])
                want[key] = max(want.get(key, 0), alike)
                mixed += (len(found[i]) < S.FEW_SPOTS) != (len(found[j]) < S.FEW_SPOTS)
    members, pairs = S.alike_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold)
    assert mixed > 5 and {(p.a, p.b): p.likeness for p in pairs.collect()} == want
    assert {m.id: m.class_id for m in members.collect()} == dict(enumerate(classes))
