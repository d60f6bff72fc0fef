"""BPE automaton, unigram counts and packing against the public libraries and brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from bidscope.llm import best_fit_packing as B
from bidscope.llm import bpe_automaton as A
from bidscope.llm import queries as Q
from bidscope.llm import unigram_counts as U
from bidscope.llm.common import table
from conftest import SF001

WORD, BYTE, PIECES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = "abcdeéÉßΣσςİıﬁ́ \t\n\x1c\x85'’.,!<>/w|0123456789½²Ⅷ漢字かな😀👩‍👧ñ_…-ＡÅÅ 　ǅ\x00\x7f"


def odd_texts(n):
    r = random.Random(5)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["".join(r.choice("etaoinshr ") for _ in range(60)) for _ in range(n)]


def test_small_automaton_accepts_exactly_the_bpe_tokens():
    """Every string over a small alphabet against merges applied one by one."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("ab", "ba"), ("c", "ab")]
    vocab = {s: i for i, s in enumerate(["a", "b", "c", *("".join(m) for m in merges)])}
    auto = A.MergeAutomaton(vocab, merges)
    for n in range(1, 8):
        for word in itertools.product("abc", repeat=n):
            tokens = list(word)
            for x, y in merges:
                k = 0
                while k < len(tokens) - 1:
                    if (tokens[k], tokens[k + 1]) == (x, y):
                        tokens[k:k + 2] = [x + y]
                    k += 1
            assert [auto.labels[i] for i in auto.encode("".join(word))] == tokens


def test_merges_must_be_proper():
    with pytest.raises(ValueError):
        A.MergeAutomaton({"a": 0, "b": 1, "ab": 2, "abab": 3}, [("ab", "ab"), ("a", "b")])


def test_automaton_equals_library_on_odd_texts():
    tok, mine = Tokenizer.from_file(WORD), A.coder(WORD)
    for t in [*odd_texts(1500), "<|endoftext|>x<|startoftext|> </w> a</w> e</w>f", "<|ENDOFTEXT|>", "", "x" * 2000]:
        assert np.frombuffer(mine.encode(t), "<i4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_encode_decode_round(spark, edge_docs):
    tok = Tokenizer.from_file(WORD)
    rows = A.bpe_decode(A.bpe_encode(edge_docs, WORD), WORD).collect()
    assert len(rows) == edge_docs.count() and rows[0]["key"] == "clash"
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == tok.decode(ids, skip_special_tokens=False)


def test_decode_leaves_out_unknown_ids(spark):
    df = spark.createDataFrame([([320, 10 ** 6, -1, 49407],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in A.bpe_decode(df, WORD).collect()] == [Tokenizer.from_file(WORD).decode([320, 49407], skip_special_tokens=False), "", ""]


def test_op1_query(spark):
    tok = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in Q.QUERIES["op1_bpe_encode_decode"](spark, SF001).collect()}
    for r in table(spark, SF001, "documents").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_counts_equal_library(byte_pieces):
    pieces = [p for p in U.read_pieces(PIECES) if byte_pieces or not p[0].startswith("<0x")]
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_pieces))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    mine = U.WordCounts(pieces)
    for t in [*odd_texts(800), "<0x41> <s> </s><unk>", " a", "  a  ", "▁▁a", "漢字", ""]:
        assert mine.count(t) == len(tok.encode(t, add_special_tokens=False).ids), t


def test_op2_query(spark):
    """Every text of the table against the library's unigram model."""
    tok = Tokenizer(models.Unigram(U.read_pieces(PIECES), unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    got = {r.doc_id: r.n_tokens for r in Q.QUERIES["op2_token_counts"](spark, SF001).collect()}
    assert got == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in table(spark, SF001, "documents").collect()}


def test_ties_take_the_match_that_starts_first():
    v = U.CountViterbi([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    assert v.count("aaa") == (-3.0, 1) and v.count("aaaa")[1] == 2


def test_token_counts_edges(spark, edge_docs, no_docs):
    rows = U.token_counts(edge_docs, PIECES).collect()
    assert len(rows) == edge_docs.count() and {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert U.token_counts(no_docs, PIECES).count() == 0 and A.bpe_encode(no_docs, WORD).count() == 0
    assert Q.QUERIES["op2_token_counts"](spark, SF001).count() == table(spark, SF001, "documents").count()


def fewest(items, capacity):
    """Fewest bins by exhaustive search."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1:]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    r = random.Random(7)
    for _ in range(150):
        capacity = r.choice([10, 17, 30])
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        patterns = B.complete(dict(Counter(items)), capacity)
        assert all(sum(f) <= capacity for f, _ in patterns)
        assert Counter(x for f, t in patterns for x in f * t) == Counter(items)
        assert sum(t for _, t in patterns) == fewest(items, capacity) >= B.lower_bound(dict(Counter(items)), capacity)


def test_sequences_of_five_and_more_pieces():
    """400 pieces of 419 and 600 of 400 tokens fill 200 sequences only as 2 x 419 + 3 x 400; best fit needs 220."""
    counts = {419: 400, 400: 600}
    assert sum(t for _, t in B.best_fit(counts, 2048)) == 220 and B.lower_bound(counts, 2048) == 200
    assert sum(t for _, t in B.complete(counts, 2048)) == 200


def test_fillings_are_the_undominated_ones():
    """Against every multiset of the lengths: each filling is either offered or dominated by one that is offered."""
    r = random.Random(11)
    for _ in range(60):
        counts = Counter({r.randint(2, 12): r.randint(1, 4) for _ in range(4)})
        gap = r.randint(8, 26)
        offered = list(B.fillings(counts, sorted(counts), gap, [10 ** 6]))
        assert [sum(f) for f in offered] == sorted((sum(f) for f in offered), reverse=True) and len(set(offered)) == len(offered)
        for ks in itertools.product(*(range(counts[s] + 1) for s in sorted(counts))):
            fill = tuple(x for s, k in zip(sorted(counts), ks) for x in [s] * k)
            if sum(fill) <= gap:
                assert any(fit_into(fill, o) for o in offered), (counts, gap, fill, offered)


def fit_into(items, rooms):
    """Whether the items can be put into rooms of these sizes."""
    if not items:
        return True
    return any(rooms[i] >= items[-1] and fit_into(items[:-1], (*rooms[:i], rooms[i] - items[-1], *rooms[i + 1:])) for i in range(len(rooms)) if rooms[i] not in rooms[:i])


def test_pieces_of_long_documents():
    assert B.cut(1, 5) == [(0, 1)] and B.cut(5, 5) == [(0, 5)] and B.cut(12, 5) == [(0, 2), (2, 5), (7, 5)]


def check_packing(rows, ids_of, capacity):
    seen = Counter()
    for doc, group in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.piece)), key=lambda r: r.doc_id):
        at = 0
        for r in group:
            assert r.start == at and zlib.crc32(np.array(ids_of[doc][at:at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids_of[doc])
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        seen[at <= capacity] += 1
    assert not seen[False]
    return seen[True]


def test_op5_query(spark):
    tok = Tokenizer.from_file(BYTE)
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in table(spark, SF001, "documents").collect()}
    rows = Q.QUERIES["op5_best_fit_packing"](spark, SF001).collect()
    assert check_packing(rows, ids, 2048) == B.lower_bound(dict(Counter(r.length for r in rows)), 2048)


def test_packing_edges(spark, edge_docs, no_docs):
    mine, tok = B.coder(BYTE), Tokenizer.from_file(BYTE)
    for t in [*odd_texts(500), "<|endoftext|> a", "a  b", " a", "a "]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    pieces = B.token_pieces(edge_docs, BYTE, 64)
    rows = B.pack(pieces.drop("ids"), 64).collect()
    assert Counter(r.length for r in rows) == Counter(r.length for r in pieces.collect())
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spans, spans[1:])) and all(o + n <= 64 for _, o, n in spans)
    assert B.pack(B.token_pieces(no_docs, BYTE).drop("ids")).count() == 0
    with pytest.raises(ValueError):
        B.pack(spark.sql("SELECT 1L AS doc_id, 0 AS piece, 0L AS length"), 64)
