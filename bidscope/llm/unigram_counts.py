"""Token counts of a unigram vocabulary without tokenising: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches of a word, and dynamic programming over the end
positions carries the best score and the piece count of the best path. Ties follow the ``tokenizers`` library:
of equal scores the match that starts first stays. Characters without a piece cost the lowest score less 10; a run of
them is one unknown piece, or its bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: The score of an unknown character is the vocabulary's lowest less this (a fixed value of the library).
UNKNOWN_PENALTY = 10.0
WORD_ENTRIES = 400_000
MARK = "▁"


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class CountViterbi:
    """Piece counts of single words under ``pieces`` [(text, score)]."""

    def __init__(self, pieces: list[tuple[str, float]]):
        if not pieces:
            raise ValueError("the vocabulary is empty")
        self.scores = {}
        for text, score in pieces:
            self.scores[text] = score
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.single = {t for t in self.scores if len(t) == 1}
        self.find = ahocorasick.Automaton()
        for text, score in self.scores.items():
            if text:
                self.find.add_word(text, (len(text), score))
        self.find.make_automaton()

    def count(self, word: str) -> tuple[float, int]:
        """Best score and number of pieces of ``word``."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.find.iter(word):
            ends[last + 1].append((length, score))
        best = [(0.0, 0, False)] * (n + 1)  # score, pieces, whether the last one is unknown
        for end in range(1, n + 1):
            top = None
            for length, score in sorted(ends[end], reverse=True):  # the longest match starts first
                before, pieces, _ = best[end - length]
                if top is None or before + score > top[0]:
                    top = (before + score, pieces + 1, False)
            c = word[end - 1]
            if c not in self.single:
                before, pieces, in_run = best[end - 1]
                if top is None or before + self.unknown > top[0]:
                    more = len(c.encode("utf-8", "surrogatepass")) if self.bytes else int(not in_run)
                    top = (before + self.unknown, pieces + more, True)
            best[end] = top
        return best[n][:2]


class WordCounts:
    """Counts of whole texts: a space starts a word, marked by ``▁``, and words are independent of each other."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.viterbi = CountViterbi(pieces)
        self._known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if words[0] == "":  # the text's own first space is the mark of its first word
            words = words[1:]
        known = self._known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > WORD_ENTRIES:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.viterbi.count(MARK + w)[1]
        return sum([known[w] for w in words])


_COUNTERS: dict[str, WordCounts] = {}


def counter(path: str) -> WordCounts:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounts(read_pieces(path))
    return _COUNTERS[path]


def token_counts(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Add ``out_col`` (long): the number of pieces of the whole ``text_col`` under the unigram vocabulary at ``path``.

    A null or empty text has 0 pieces. Rows are independent; an existing column named ``out_col`` is replaced; an
    empty table stays empty.
    """

    def make():
        c = counter(path)
        return lambda b: [pa.array(np.fromiter((c.count(t or "") for t in b.column(text_col).to_pylist()), dtype=np.int64, count=b.num_rows))]

    return add_columns(df, [T.StructField(out_col, T.LongType())], make)
