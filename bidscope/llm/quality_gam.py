"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn and adds a shallow tree on the feature's bins to its lookup table; pairs
that explain most of what remains get two-dimensional tables in the same way. A score is the sum of table entries, looked up
for a whole batch at a time. Features come from the text alone and see all of it.

The model is fitted on a bounded sample of labelled rows (``max_rows``, those with the smallest hash of their id, so the
choice does not depend on partitions).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "stop", "comma", "bang", "bar", "wide", "unique",
            "repeat", "log_lines", "line_words", "line_unique", "sentence_words")
MAX_ROWS = 20_000
THRESHOLD = 0.3


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@\\^_`{}~", b".?", b",;:", b"!", b"|"), 1):
        out[list(chars)] = k
    out[128:] = 8
    return out


BYTE_CLASS = _byte_classes()


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    count = np.bincount(BYTE_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = max(1, sum(map(len, words)))
    return [np.log1p(n), np.log1p(w), solid / w, *(count[1:9] / solid).tolist(), len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
            np.log1p(len(lines)), w / len(lines), len(set(lines)) / len(lines), w / (1 + int(count[4]))]


def add_features(df: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """Add ``out_col`` (array<double>), see :func:`features`."""

    def make():
        return lambda b: [pa.array([features(t) for t in b.column(text_col).to_pylist()], pa.list_(pa.float64()))]

    return add_columns(df, [T.StructField(out_col, T.ArrayType(T.DoubleType()))], make)


@dataclass
class Gam:
    """Bin edges and tables: ``edges[f]`` cuts feature ``f``; ``pairs`` use the coarse edges."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edge, x[:, f], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Up to ``bins - 1`` cut points between different values, at even ranks."""
    u = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return u[u > values.min()] if len(values) else u


def tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, ridge: float = 1.0) -> np.ndarray:
    """Values of a tree of up to ``leaves`` leaves on ordered bins, split where the gain is largest."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    spans = [(0, len(grad))]
    while len(spans) < leaves:
        best = None
        for k, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = worth(a, at) + worth(at, b) - worth(a, b)
            gain[(h[at] - h[a] < least) | (h[b] - h[at] < least)] = -1
            j = int(gain.argmax())
            if gain[j] > 1e-9 and (best is None or gain[j] > best[0]):
                best = (gain[j], k, a, int(at[j]), b)
        if best is None:
            break
        _, k, a, m, b = best
        spans[k:k + 1] = [(a, m), (m, b)]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def corner_tree(grad: np.ndarray, hess: np.ndarray, least: float, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best table of four quadrants: one cut on each axis; its gain and its values."""
    def parts(x):
        c = x.cumsum(0).cumsum(1)
        a, b, t = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        q = c[:-1, :-1]
        return q, a - q, b - q, t - a - b + q

    if min(grad.shape) < 2:
        return 0.0, np.zeros_like(grad)
    gs, hs = parts(grad), parts(hess)
    gain = sum(g * g / (h + ridge) for g, h in zip(gs, hs)) - grad.sum() ** 2 / (hess.sum() + ridge)
    gain[np.min(hs, axis=0) < least] = -1
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(grad)
    for (r, c), g, h in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs):
        out[r, c] = g[i, j] / (h[i, j] + ridge)
    return float(max(gain[i, j], 0)), out if gain[i, j] > 1e-9 else np.zeros_like(grad)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 48, pair_bins: int = 12, n_pairs: int = 8, pair_rounds: int = 60, leaves: int = 3, least: float = 2.0) -> Gam:
    """Fit on rows ``x`` with labels ``y`` (0/1). Without rows of both labels the score is constant."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    ones = float(np.sum(y))
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if not n or ones in (0, n):
        return Gam(base, [np.zeros(0)] * k, [np.zeros(0)] * k, [np.zeros(1)] * k)
    edges, coarse = [cuts(x[:, f], bins) for f in range(k)], [cuts(x[:, f], pair_bins) for f in range(k)]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    model = Gam(base, edges, coarse, [np.zeros(len(e) + 1) for e in edges])
    total = np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            if not len(edges[f]):
                continue
            g, h = slopes()
            size = len(edges[f]) + 1
            step = rate * tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), leaves, least)
            model.tables[f] += step
            total += step[at[f]]
    g, h = slopes()

    def grid(a, b, v):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(low[a] * shape[1] + low[b], v, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((corner_tree(grid(a, b, g), grid(a, b, h), least)[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for gain, a, b in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = slopes()
            _, step = corner_tree(grid(a, b, g), grid(a, b, h), least)
            table += rate * step
            total += rate * step[low[a], low[b]]
    return model


def held_out(id_col, folds: int = 5):
    """Whether the CRC-32 of the id's decimal text leaves remainder 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def training_rows(df: DataFrame, labels: DataFrame, label_col: str, folds: int, max_rows: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled rows outside the held-out fold: those with the smallest hash of the id, also
    where rows of ``df`` repeat an id."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"), folds))
    known = (known.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y"))
             .orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows))
    rows = df.select(F.col("doc_id").cast("long").alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    found = add_features(rows.select("text", "_y", "_id")).select("features", "_y", "_id")
    got = found.orderBy(F.xxhash64("_id"), "_id", "_y", "features").limit(max_rows).toArrow()  # the sample is bounded, and so is what it sends
    order = np.argsort(got["_id"].to_numpy(), kind="stable")  # the same model whatever the order of arrival
    x = np.array(got["features"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return x[order], got["_y"].to_numpy()[order]


def fit_quality(df: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, max_rows: int = MAX_ROWS, text_col: str = "text") -> Gam:
    """The model of ``labels`` (``doc_id`` and 0/1 in ``label_col``; other values and nulls are left out) for the texts of ``df``."""
    return fit(*training_rows(df, labels, label_col, folds, max_rows, text_col))


def add_scores(df: DataFrame, model: Gam, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add ``out_col`` (double, 0 to 1): the model's probability of label 1 for the whole text. Null and empty texts are
    scored like any text; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def make():
        m = shared.value
        return lambda b: [pa.array(m.score(np.array([features(t) for t in b.column(text_col).to_pylist()], dtype=float).reshape(b.num_rows, len(FEATURES))))]

    return add_columns(df, [T.StructField(out_col, T.DoubleType())], make)


def score_quality(df: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD,
                  text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, held_out, score, predicted)`` per row of ``df``: ``score`` is the probability of label 1.

    The model learns from rows of ``df`` with a label 0 or 1 in ``labels`` outside the held-out fold; nothing but the text
    enters a score. A null id is never held out nor learnt from. Without usable labels of both kinds all scores are equal.
    Repeated rows are scored alike; an empty table gives no rows.
    """
    model = fit_quality(df, labels, label_col, folds, max_rows, text_col)
    scored = add_scores(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
