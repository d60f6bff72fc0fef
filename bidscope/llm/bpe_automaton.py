"""BPE encoding and decoding with a tokenisation automaton.

The merges are compiled one after the other by the merge gadget, starting from the automaton with one state and a
loop for every base symbol. The gadget of a merge ``a b -> c`` gives ``c``-arcs to all states that have an ``a``-arc
(leading where ``b`` led from there) and leads all ``a``-arcs to a copy of their target without its ``b``-arc.
Afterwards every string has exactly one path, whose labels are its BPE tokens, and all arcs with one label end in
one state. States are kept as differences to the state they were copied from: ``cut`` has the arcs that a copy
lost, ``born`` the step at which a label's arcs appeared, so that an arc is looked up along the copies.

A label's arcs all end in one state, so the state of a prefix is the last label of its path. A word is encoded left to right: an
Aho-Corasick automaton over the labels' texts gives the labels that end at each place, and the transition table, filled from the
gadgets' tables as its cells are first used, tells which one has an arc from the state where it begins. Decoding emits the labels.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

#: Entries of a worker's tables from text chunks and words to ids; a full one becomes the older one, whose entries come back as they are
#: used, and the older one goes (memory bound, no effect on results).
CHUNK_ENTRIES = 150_000
STEP_ENTRIES = 1_000_000
#: str.split() also takes these four control characters for white space; the library doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Tables of the compiled automaton. Labels are the vocabulary's ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.labels = {i: s for s, i in vocab.items()}
        self.inner: dict[str, int] = {}  # text of a label inside a word
        self.final: dict[str, int] = self.inner if not end else {}  # text of a label that ends a word
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self._step: dict[int, bool] = {}
        made = {a + b for a, b in merges}
        for s, i in vocab.items():
            if s not in made:
                self.born[i] = 0
                if end and s.endswith(end) and len(s) == len(end) + 1:
                    self.final[s[:-len(end)]] = i
                elif len(s) == 1:
                    self.inner[s] = i
        ends = set(self.final.values()) if end else set()
        for at, (a, b) in enumerate(merges, 1):
            a_id, b_id, c_id = vocab[a], vocab[b], vocab[a + b]
            if c_id in self.born or a_id not in self.born or b_id not in self.born:
                raise ValueError(f"merge {at} ({a} {b}) is not a proper merge")
            self._gadget(at, a_id, b_id, c_id)
            if b_id in ends:
                ends.add(c_id)
                self.final[(a + b)[:-len(end)]] = c_id
            else:
                self.inner[a + b] = c_id
        self.size = max(self.labels, default=0) + 1
        self.ending = ahocorasick.Automaton()
        for text in self.inner.keys() | self.final.keys():
            self.ending.add_word(text, (len(text), self.inner.get(text, -1), self.final.get(text, -1)))
        self.ending.make_automaton()

    def _gadget(self, at: int, a: int, b: int, c: int) -> None:
        self.cut[a, b] = at
        self.born[c], self.left[c], self.right[c] = at, a, b

    def step(self, u: int, v: int) -> bool:
        """Whether the state that arcs labelled ``u`` lead to has an arc labelled ``v``; fills the table's cell."""
        if len(self._step) > STEP_ENTRIES:
            self._step.clear()
        known = self._step[u * self.size + v] = self._find(u, v)
        return known

    def _find(self, u: int, v: int) -> bool:
        cut, born, before = self.cut, self.born, len(self.cut) + 1
        while True:
            if cut.get((u, v), before) < before:
                return False
            bu, bv = born[u], born[v]
            if not bu and not bv:
                return True
            if bu > bv:  # the state was at that step where the right part led, without the gadget's own cut
                u, before = self.right[u], bu
            else:  # the arc was added at that step to states with an arc for its left part
                v, before = self.left[v], bv + 1

    def encode(self, word: str) -> list[int]:
        """Labels of the path of ``word``, given in byte symbols."""
        n = len(word)
        if (whole := self.final.get(word)) is not None:
            return [whole]
        if n < 2:
            return self._with_gaps(word)
        state, came = [-1] * (n + 1), [0] * (n + 1)
        table, size = self._step, self.size
        done = -1
        for end, (length, inside, last) in self.ending.iter(word):
            if end == done:  # the longer label of the path was found
                continue
            i = end + 1
            t = inside if i < n else last
            if t < 0:
                continue
            j = i - length
            if j:
                u = state[j]
                if u < 0:
                    continue
                arc = table.get(u * size + t)
                if arc is None:
                    arc = self.step(u, t)
                if not arc:
                    continue
            state[i], came[i], done = t, j, end
        out = []
        while n:
            t = state[n]
            if t < 0:  # a symbol outside the vocabulary has no arc
                return self._with_gaps(word)
            out.append(t)
            n = came[n]
        return out[::-1]

    def _with_gaps(self, word: str) -> list[int]:
        """Symbols without any arc are left out, as the library does without an unknown token."""
        known = "".join(c for k, c in enumerate(word) if c in (self.final if k == len(word) - 1 else self.inner))
        return self.encode(known) if known and known != word else []


class WordBpe:
    """A tokenizer file of the ``tokenizers`` library: normaliser, word split, special tokens and the automaton.

    Supports files whose normaliser is NFC, white space to one space, lower case, whose words are split by one pattern
    and written in byte symbols, with an end-of-word suffix and without a decoder (tokens are joined by a space).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or spec["decoder"] or model["unk_token"]:
            raise ValueError("unsupported tokenizer file")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        self._chunks: dict[str, bytes] = {}
        self._old_chunks: dict[str, bytes] = {}
        self._words: dict[str, list[int]] = {}
        self._old_words: dict[str, list[int]] = {}

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one piece of text without white space, as little-endian 32-bit numbers."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = unicodedata.normalize("NFC", chunk)
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # letter by letter
        ids = array("i")
        words = self._words
        for w in self.words.findall(text):
            known = words.get(w)
            if known is None:
                known = self._old_words.get(w)
                if known is None:
                    plain = w.isascii() and w.isalnum()  # such bytes are their own symbols
                    known = self.automaton.encode(w if plain else w.encode("utf-8").decode("latin-1").translate(self.bytes))
                words[w] = known
            ids.extend(known)
        if len(words) > CHUNK_ENTRIES:
            self._old_words, self._words = words, {}
        return ids.tobytes()

    def _plain(self, text: str) -> bytes:
        chunks, known = text.split() if not _SEPARATORS.search(text) else _SPACES.split(text), self._chunks
        parts = list(map(known.get, chunks))
        if None in parts:
            if len(known) > CHUNK_ENTRIES:
                self._old_chunks = known
                known = self._chunks = {}
            old = self._old_chunks
            for k, (c, part) in enumerate(zip(chunks, parts)):
                if part is None:
                    part = known.get(c)
                    if part is None:
                        part = old.get(c)
                        known[c] = part = self._chunk(c) if part is None else part
                    parts[k] = part
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        if self.marks is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.marks.split(text)
        return b"".join(np.int32(self.special[p]).astype("<i4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))


_CODERS: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """The compiled automaton of a file, once per Python worker."""
    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


def id_lists(parts: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(p) // 4 for p in parts), dtype=np.int64, count=len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (array<int>): the BPE ids of the whole ``text_col``; a null or empty text gives an empty array.

    Rows are independent (repeated rows get equal ids, an empty table stays empty); an existing column named
    ``ids_col`` is replaced. ``path`` is a tokenizer file that every executor can read.
    """

    def make():
        c = coder(path)
        return lambda b: [id_lists([c.encode(t or "") for t in b.column(text_col).to_pylist()])]

    return add_columns(df, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the labels of ``ids_col`` joined by one space; special tokens stay. Null ids give ''.

    Ids outside the vocabulary have no label and are left out.
    """

    def make():
        labels = coder(path).labels
        table = pa.array([labels.get(i) for i in range(max(labels) + 1)], pa.string())

        def work(b):
            lists = b.column(ids_col)
            out = []
            for k in range(len(lists)):  # one row at a time: the joined text of many rows may pass 2 GB
                ids = lists[k].values
                if ids is None or not len(ids):
                    out.append("")
                    continue
                ids = ids.filter(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(table))))
                out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), table.take(ids)).cast(pa.list_(pa.string())), " ")[0].as_py() or "" if ids.null_count == 0 and table.take(ids).null_count == 0 else " ".join(x for x in table.take(ids).to_pylist() if x is not None))
            return [pa.array(out, pa.string())]

        return work

    return add_columns(df, [T.StructField(text_col, T.StringType())], make)


def id_digest(ids_col: str):
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " ").cast("binary"), 256)
