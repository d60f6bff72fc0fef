"""Ranked lexical search by bag deduplication.

Every item of a query set is ranked against all documents. For a block of items:

1. Documents are restricted to the items' vocabulary: a document becomes its sorted (term, tf) vector and its number of terms.
   One pass over the texts also gives the corpus statistics (documents, terms, document frequencies) by aggregates.
2. Documents of one class (equal vector and equal length norm ``m``) have equal scores for every item. They are found by a hash
   of the vector and verified by the vector itself; a class keeps its first ``k`` document ids, as no later member of it
   can be among the ``k`` best of an item. Copies meet map-side first, so a large class is no large group.
3. Each class is scored once, through the postings of the items; every task keeps the ``k`` best classes of each item.
4. The best classes of an item are expanded by ascending document id.

Scores are exact 64-bit integers; only a term's weight is computed in doubles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored

#: Items and distinct (item, term) pairs of one block; a block is held by the driver and broadcast.
BLOCK_ITEMS = 2000
BLOCK_TERMS = 1 << 18
#: Cells of the score table (classes x items) that a task fills at once.
CELLS = 1 << 20
#: Weights and sums up to here are exact in doubles.
EXACT = 1 << 53

#: Term characters stay, of which A-Z become a-z; all other ASCII bytes become a blank. Bytes above 127 are parts of term characters.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")


def term_counts(text: str | None) -> Counter:
    out = Counter(terms_of(text))
    out.pop(b"", None)
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative numbers below 2^32 in seven-bit groups, the smallest group first; and the end of each number."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
        out[ends[has] - size[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes(), ends


def unpack(data: bytes) -> np.ndarray:
    """The numbers of :func:`pack`."""
    b = np.frombuffer(data, dtype=np.uint8)
    last = b < 128
    ends = np.flatnonzero(last)
    which = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(b) else np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], ends[:-1] + 1])
    shift = (7 * (np.arange(len(b)) - first[which])).astype(np.uint64) if len(b) else np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ends), dtype=np.int64)
    np.add.at(out, which, ((b & 127).astype(np.uint64) << shift).astype(np.int64))
    return out


class ItemBlock:
    """Some items: their vocabulary and, by term, the items that hold it with the number of times."""

    def __init__(self, items: list[tuple[int | None, Counter]]):
        self.ids = [i for i, _ in items]
        self.vocab = {t: k for k, t in enumerate(sorted({t for _, c in items for t in c}))}
        rows = sorted((self.vocab[t], i, n) for i, (_, c) in enumerate(items) for t, n in c.items())
        self.item = np.array([i for _, i, _ in rows], dtype=np.int64)
        self.times = np.array([n for _, _, n in rows], dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(np.array([t for t, _, _ in rows], dtype=np.int64), minlength=len(self.vocab)))])
        self.weight = np.zeros(len(self.vocab), dtype=np.int64)

    def with_weights(self, n_docs: int, df: dict[int, int]) -> ItemBlock:
        self.weight = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(self.vocab))], dtype=np.int64)
        return self

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores (``n_rows`` x items) of the vectors given as (row, term, tf), ``m`` by row."""
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
        count = self.ends[term + 1] - self.ends[term]
        at = np.repeat(np.arange(len(term)), count)
        post = self.ends[term][at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        cell = row[at] * len(self.ids) + self.item[post]
        value = part[at] * self.times[post]
        size = n_rows * len(self.ids)
        # doubles add whole numbers exactly up to EXACT; larger ones are added in two parts
        if not len(value) or int(value.max()) * int(np.bincount(cell, minlength=1).max()) < EXACT:
            out = np.bincount(cell, weights=value, minlength=size).astype(np.int64)
        else:
            high, low = value >> 24, value & ((1 << 24) - 1)
            out = (np.bincount(cell, weights=high, minlength=size).astype(np.int64) << 24) + np.bincount(cell, weights=low, minlength=size).astype(np.int64)
        return out.reshape(n_rows, len(self.ids))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemBlock]:
    """The items in blocks, read partition by partition. Equal rows count once."""
    hold: list[tuple[int | None, Counter]] = []
    size = 0
    for r in items.select(F.col(id_col).cast("long"), F.col(text_col)).distinct().toLocalIterator():
        terms = term_counts(r[1])
        if not terms:
            continue
        if hold and (len(hold) >= BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            yield ItemBlock(hold)
            hold, size = [], 0
        hold.append((r[0], terms))
        size += len(terms)
    if hold:
        yield ItemBlock(hold)


def vectors(docs: DataFrame, id_col: str, text_col: str, block) -> DataFrame:
    """Rows ``(id, n, vec)``: number of terms, and the term counts within the block's vocabulary (null without any)."""

    def run(batches):
        vocab = block.value.vocab
        for b in batches:
            n, size, terms, tfs = [], [], [], []
            for text in b.column("text").to_pylist():
                words = terms_of(text)
                counts = Counter(words)
                n.append(len(words) - counts.pop(b"", 0))
                known = sorted((vocab[w], c) for w, c in counts.items() if w in vocab)
                size.append(len(known))
                terms += [t for t, _ in known]
                tfs += [c for _, c in known]
            size = np.array(size, dtype=np.int64)
            term = np.array(terms, dtype=np.int64)
            step = np.diff(term, prepend=0)
            begin = (np.cumsum(size) - size)[size > 0]
            step[begin] = term[begin]
            data, ends = pack(np.stack([step, np.array(tfs, dtype=np.int64)], axis=1).ravel())
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(2 * size)])]
            vec = [data[x:y] if y > x else None for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(vec, pa.binary())], names=["id", "n", "vec"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, vec binary")


def read_vectors(vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed vectors as (row, term, tf)."""
    both = unpack(b"".join(vecs)).reshape(-1, 2)
    size = np.array([np.count_nonzero(np.frombuffer(v, dtype=np.uint8) < 128) // 2 for v in vecs], dtype=np.int64)
    row = np.repeat(np.arange(len(vecs)), size)
    total = np.cumsum(both[:, 0])
    begin = (np.cumsum(size) - size)[size > 0]
    base = np.zeros(len(vecs), dtype=np.int64)
    base[size > 0] = total[begin] - both[begin, 0]
    return row, total - base[row], both[:, 1]


def document_frequencies(vecs: DataFrame) -> dict[int, int]:
    """Documents by term of the block's vocabulary."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            found = np.bincount(read_vectors(b.column("vec").to_pylist())[1])
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[:len(found)] += found
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    return {r.term: r.n for r in vecs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def best_classes(classes: DataFrame, block, k: int) -> DataFrame:
    """The ``k`` best classes of each item in every task: ``(item, score, key, m, first)``."""

    def run(batches):
        own = block.value
        items = len(own.ids)
        rows = max(1, CELLS // items)
        best: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, first id, row of `known`
        known: list[tuple[bytes, int, int | None]] = []
        floor = np.zeros(items, dtype=np.int64)  # the k-th best score so far
        for b in batches:
            for at in range(0, b.num_rows, rows):
                c = b.slice(at, rows)
                m = c.column("m").to_numpy()
                first = c.column("first").to_pylist()
                row, term, tf = read_vectors(c.column("vec").to_pylist())
                s = own.scores(row, term, tf, m, c.num_rows)
                r, i = np.nonzero((s >= floor) & (s > 0))
                if not len(r):
                    continue
                order = np.array([np.iinfo(np.int64).max if x is None else x for x in first], dtype=np.int64)
                keys = c.column("key").to_pylist()
                used, place = np.unique(r, return_inverse=True)
                base = len(known)
                known += [(keys[x], int(m[x]), first[x]) for x in used.tolist()]
                new = [i, s[r, i], order[r], place + base]
                best = [np.concatenate([x, y]) for x, y in zip(best, new)]
                sort = np.lexsort((best[2], -best[1], best[0]))
                best = [x[sort] for x in best]
                begin = np.searchsorted(best[0], np.arange(items))
                keep = np.arange(len(best[0])) - begin[best[0]] < k
                best = [x[keep] for x in best]
                count = np.bincount(best[0], minlength=items)
                full = np.flatnonzero(count >= k)
                floor[full] = best[1][np.searchsorted(best[0], full, side="right") - 1]
                if len(known) > 4 * items * k:
                    used, place = np.unique(best[3], return_inverse=True)
                    known, best[3] = [known[x] for x in used.tolist()], place
        if len(best[0]):
            at = best[3].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array([known[x][0] for x in at], pa.binary()), pa.array([known[x][1] for x in at], pa.int64()),
                                              pa.array([known[x][2] for x in at], pa.int64())], names=["item", "score", "key", "m", "first"])

    return classes.select("key", "m", "first", "vec").mapInArrow(run, "item long, score long, key binary, m long, first long")


def rank_block(docs: DataFrame, block: ItemBlock, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vecs = stored(vectors(docs, id_col, text_col, spark.sparkContext.broadcast(block)), "vectors")
    n_docs, n_terms = vecs.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    some = vecs.where("vec is not null")
    ready = spark.sparkContext.broadcast(block.with_weights(n_docs, document_frequencies(some)))
    m = F.expr(f"100 - 25 + ((25 * n * {n_docs}L) div {max(n_terms, 1)}L)")
    bags = some.select("id", m.alias("m"), F.unhex(F.md5("vec")).alias("key"), "vec")
    by_id = Window.partitionBy("key", "m", "vec").orderBy(F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    members = bags.select("*", F.row_number().over(by_id).alias("at"), F.first("id").over(by_id).alias("first")).where(F.col("at") <= k)
    members = stored(members.select("key", "m", "id", "at", "first", F.when(F.col("at") == 1, F.col("vec")).alias("vec")), "members")
    found = best_classes(members.where("at = 1"), ready, k)
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last(), "key", "m")
    found = stored(found.withColumn("at", F.row_number().over(by_item)).where(F.col("at") <= k).drop("at"), "best")
    same = (F.col("c.key") == F.col("d.key")) & (F.col("c.m") == F.col("d.m")) & F.col("c.first").eqNullSafe(F.col("d.first"))
    both = found.alias("c").join(members.drop("vec").alias("d"), same).select("c.item", "c.score", "d.id")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], "item long, item_id long")  # of one block
    return ranked.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: ``(item_id, rank, doc_id, score)``, scores above 0 only.

    Terms are the maximal runs of ASCII letters and digits and of characters above U+007F; only A-Z are lower-cased. With N
    documents that hold a term, L terms in all, n terms of a document, df documents that hold a term and tf its number of
    times in the document: weight floor(1000 ln((2N + 2) / (2 df + 1))), m = 100 - 25 + (25 n N) div L, and the score is the sum of
    weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, with repeats.

    Equal scores go by ascending document id, null ids last. Null and empty texts have no terms: such documents are never found
    and such items have no rows. Every row of ``docs`` is a document, also where rows repeat an id; equal rows of ``items`` are one
    item, and different texts under one item id are ranked each. Other columns are ignored. Empty tables give no rows. The
    items are taken in blocks of ``BLOCK_ITEMS``; every block is a pass over the documents.
    """
    bound_batches(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item_id_col, item_text_col):
        out = out.unionByName(rank_block(docs, block, k, id_col, text_col))
    return out


def sql(k: int = 20, docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL for ``(item_id, rank, doc_id, score)``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH asked AS (SELECT item_id, text, unnest({words}) AS term FROM (SELECT DISTINCT item_id, text FROM {items})),
q AS (SELECT item_id, text, term, count(*) AS times FROM asked GROUP BY 1, 2, 3),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS terms FROM {docs}),
totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
t AS (SELECT r, unnest(terms) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(terms) * n_docs) // n_terms AS m FROM d, totals WHERE len(terms) > 0),
scored AS (SELECT q.item_id, q.text, m.r, m.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m)))::BIGINT AS score
           FROM q JOIN tf ON q.term = tf.term JOIN w ON q.term = w.term JOIN m ON tf.r = m.r GROUP BY 1, 2, 3, 4),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
