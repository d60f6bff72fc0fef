"""SimHash near-duplicates: fingerprints of word shingles joined on pigeonhole blocks.

Two 64-bit fingerprints that differ in at most ``d`` bits agree on at least ``a`` of ``d + a`` blocks. Every choice of
``a`` blocks is a join key, so all close pairs share a key; with ``a`` = 3 a key has about 27 bits and random
fingerprints rarely meet. The Hamming distance then verifies each pair that shares a key.

Equal fingerprints are one class before the join, so copies never multiply. Within a key the members are searched
seed by seed with vectorised distances and only the links of a spanning forest leave the task: a group of ``n`` close
fingerprints gives ``n - 1`` rows, not all its pairs, and loses no connection.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, components, stored, tidy

BITS = 64
SEED = 42
_ROWS = 1 << 16


def simhash(text: str | None, shingle_words: int) -> int:
    """64-bit fingerprint: a bit is 1 if more than half the shingles' XXH64 values (seed 42) have it.

    A-Z are lower-cased, words are runs without ASCII white space, shingles keep their repeats; a text of fewer words
    is one shingle of all of them, a text without words (or null) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = shingle_words
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        values = [h(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts = (stops - sizes)[: len(words) - k + 1].tolist()
        values = [h(line[a:b], SEED) for a, b in zip(starts, stops[k - 1:].tolist())]
    hashes = np.array(values, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _ROWS):
        part = hashes[at:at + _ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", shingle_words: int = 4, out_col: str = "fingerprint") -> DataFrame:
    """Add ``out_col`` (long, the 64 bits): see :func:`simhash`. An existing column of that name is replaced."""

    def make():
        return lambda b: [pa.array(np.array([simhash(t, shingle_words) for t in b.column(text_col).to_pylist()], dtype=np.uint64).view(np.int64))]

    return add_columns(df, [T.StructField(out_col, T.LongType())], make)


def block_masks(max_bits: int, agree: int) -> list[int]:
    """One mask for each choice of ``agree`` out of ``max_bits + agree`` blocks, as signed 64-bit numbers."""
    n = max_bits + agree
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def forest(bits: np.ndarray, nodes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of fingerprints at most ``max_bits`` apart."""
    left, links, todo = np.arange(1, len(bits)), [], [0]
    while len(left):
        if not todo:
            todo.append(int(left[0]))
            left = left[1:]
            continue
        seed = todo.pop()
        near = np.bitwise_count(bits[left] ^ bits[seed]) <= max_bits
        if near.any():
            found = left[near]
            left = left[~near]
            todo.extend(found.tolist())
            links.extend((int(nodes[seed]), int(nodes[x])) for x in found)
    return links


def close_links(classes: DataFrame, max_bits: int, agree: int = 3) -> DataFrame:
    """Links ``(src, dst)`` of ``classes(node, fingerprint)`` that connect all fingerprints within ``max_bits``."""
    masks = block_masks(max_bits, agree)
    keyed = (classes.where("node is not null")
             .select("node", "fingerprint", F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks))).alias("choice", "key"))
             .repartition("choice", "key").sortWithinPartitions("choice", "key"))

    def run(batches):
        rest = None  # rows of the last key, which may go on in the next batch
        for b in batches:
            part = [b.column(c).to_numpy() for c in ("choice", "key", "node", "fingerprint")]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            cuts = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = [x[last:] for x in part]
            yield links(part, np.concatenate([[0], cuts]))
        if rest is not None:
            yield links(rest, np.array([0, len(rest[0])]))

    def links(part, edges):
        bits, nodes, out = part[3].view(np.uint64), part[2], []
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        if len(two):
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= max_bits]
            out += zip(nodes[two].tolist(), nodes[two + 1].tolist())
        for a, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            out += forest(bits[a:a + n], nodes[a:a + n], max_bits)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["src", "dst"])

    return keyed.mapInArrow(tidy(run), "src long, dst long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row ``(id, fingerprint, component_id)`` per row of ``df``; ``component_id`` is the smallest id that links of
    at most ``max_bits`` differing bits reach, the row's own included.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id get the component of their
    fingerprint, if another row has it. Repeated rows each return a row; an id on rows of different texts is one node,
    so it joins their groups. An empty table gives no rows; other columns are not looked at.
    """
    prints = stored(add_fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle_words)
                    .select("id", "fingerprint"), "simhash")
    # one row per (fingerprint, smallest id); an id with several fingerprints links them
    classes = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("node")), "classes")
    shared = (prints.where("id is not null").join(classes, "fingerprint").where("id <> node")
              .select(F.col("id").alias("src"), F.col("node").alias("dst")))
    several = prints.where("id is not null").groupBy("id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").select("id")
    shared = shared.join(several, shared.src == several.id, "left_semi")
    found = components(close_links(classes, max_bits).unionByName(shared))
    labelled = stored(classes.join(found, "node", "left")
                      .select("fingerprint", F.coalesce("component", "node").alias("component_id")), "labels")
    return prints.join(labelled, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")
