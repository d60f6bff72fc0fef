"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors cosine >= c means a squared distance of at most D = 2 - 2c. The vectors are rotated by a fixed random
rotation and cut into blocks of few dimensions. If fewer than ``k`` blocks of a pair are within D / (m - k + 1), the
other blocks alone exceed D; so every wanted pair is found in at least ``k`` of the ``m`` blocks (budgets in proportion
to the blocks' widths). Each block is range-joined by a grid over its first dimensions, pairs found in ``k`` blocks are
united and verified exactly, in double precision on the original components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, stored

BLOCK_WIDTH = 8
GRID_DIMS = 2
#: A pair must be found in so many blocks. With 2 the budget of a block is D / (m - 1).
AGREE = 2
#: Home rows of a cell that one task holds at a time; larger cells are split, and their probes go to all parts.
CELL_ROWS = 20_000
SEED = 20240917
#: Added to the budgets against rounding: candidates are verified exactly.
SLACK = 1e-5


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_spans(dim: int) -> list[tuple[int, int]]:
    m = max(1, -(-dim // BLOCK_WIDTH))
    edges = [dim * i // m for i in range(m + 1)]
    return list(zip(edges, edges[1:]))


def budgets(dim: int, limit: float) -> np.ndarray:
    """Squared radius of each block, in proportion to its width.

    With equal shares D / (m - k + 1); unequal widths scale it so that any m - k + 1 blocks together exceed D.
    """
    spans = block_spans(dim)
    widths = np.array([b - a for a, b in spans], dtype=float)
    k = min(AGREE, len(spans))
    share = limit / np.sort(widths)[: len(spans) - k + 1].sum()
    return widths * share + SLACK


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``(id, v, dim)``: ``v`` has the components as doubles (bytes); null where the vector links with nothing."""

    def run(batches):
        for b in batches:
            ids, out, dims = b.column("id"), [], []
            for x in b.column("x").to_pylist():
                a = np.array(x if x is not None and None not in x else [], dtype="<f8")
                size = np.linalg.norm(a / np.abs(a).max()) if len(a) and np.isfinite(a).all() and np.abs(a).max() > 0 else 0
                out.append((a / np.abs(a).max()).tobytes() if size else None)
                dims.append(len(a) if size else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["id", "v", "dim"])

    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return x.mapInArrow(run, "id long, v binary, dim int")


def cells(reps: DataFrame, limit: float) -> DataFrame:
    """Rows ``(dim, block, cell, probe, id, y)``: every vector's home cell and the cells that its ball meets, for each block."""

    def run(batches):
        for b in batches:
            ids, dims = b.column("id").to_numpy(), b.column("dim").to_numpy()
            vectors = b.column("v").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(vectors[i] for i in at), dtype="<f8").reshape(len(at), dim)
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(int(dim))
                for k, ((lo, hi), r2) in enumerate(zip(block_spans(int(dim)), budgets(int(dim), limit))):
                    part, r = y[:, lo:hi], np.sqrt(r2)
                    width, g = 2 * r, min(GRID_DIMS, hi - lo)
                    grid = part[:, :g]
                    home = np.floor(grid / width).astype(np.int64)
                    low, high = np.floor((grid - r) / width).astype(np.int64), np.floor((grid + r) / width).astype(np.int64)
                    coords = np.ascontiguousarray(part, dtype="<f4")
                    for step in np.ndindex(*([2] * g)):  # a ball of radius r meets at most two cells in each dimension
                        cell = np.where(np.array(step) == 0, low, high)
                        new = ((np.array(step) == 0) | (high > low)).all(axis=1)
                        gap = np.maximum(np.maximum(cell * width - grid, grid - (cell + 1) * width), 0)
                        keep = new & ((gap ** 2).sum(axis=1) <= r2 + SLACK)
                        yield rows(dim, k, cell[keep], True, ids[at][keep], coords[keep])
                    yield rows(dim, k, home, False, ids[at], coords)

    def rows(dim, k, cell, probe, ids, coords):
        key = np.zeros(len(ids), dtype=np.int64)
        for j in range(cell.shape[1]):
            key = key * 2_000_003 + cell[:, j]
        n, size = len(ids), coords.shape[1] * 4
        data = pa.py_buffer(np.ascontiguousarray(coords).tobytes())
        y = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32).tobytes()), data])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(key), pa.array(np.full(n, probe)), pa.array(ids), y], names=["dim", "block", "cell", "probe", "id", "y"])

    return reps.select("id", "v", "dim").mapInArrow(run, "dim int, block int, cell long, probe boolean, id long, y binary")


def candidates(reps: DataFrame, limit: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, found within budget in at least ``AGREE`` blocks."""
    placed = stored(cells(reps, limit), "cells")
    homes, probes = placed.where("not probe"), placed.where("probe")
    parts = homes.groupBy("dim", "block", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).cast("int").alias("parts"))
    homes = homes.join(parts, ["dim", "block", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    probes = probes.join(parts, ["dim", "block", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["dim", "block", "cell", "part", "probe", "id", "y"]
    both = homes.select(cols).unionByName(probes.select(cols))
    keys = ["dim", "block", "cell", "part"]

    def run(batches):
        key = home = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            c = [b.column(n).to_numpy(zero_copy_only=False) for n in (*keys, "probe", "id")]
            change = np.zeros(len(c[0]) - 1, dtype=bool)
            for x in c[:5]:
                change |= np.diff(x.astype(np.int64)) != 0
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(c[0])]
            raw = b.column("y")
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(int(x[lo]) for x in c[:4])
                if now != key:
                    key, held, home = now, [], None
                y = np.frombuffer(b"".join(raw[lo:hi].to_pylist()), dtype="<f4").reshape(hi - lo, -1).astype(np.float32)
                if not c[4][lo]:
                    held.append((c[5][lo:hi], y))
                    continue
                if home is None and held:
                    home = (np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                if home is not None:
                    yield from near(key, home, c[5][lo:hi], y)

    def near(key, home, ids, y):
        r2 = budgets(key[0], limit)[key[1]] + SLACK
        hid, hy = home
        h2 = (hy * hy).sum(axis=1)
        for at in range(0, len(ids), 512):
            p, py = ids[at:at + 512], y[at:at + 512]
            start = int(np.searchsorted(hid, p[0], side="right"))  # homes come by id: only those above the smallest probe
            d = h2[None, start:] - 2 * (py @ hy[start:].T)
            i, j = np.nonzero(d <= (r2 - (py * py).sum(axis=1))[:, None])
            a, b = p[i], hid[start + j]
            keep = a < b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(np.full(int(keep.sum()), key[0], np.int32))], names=["a", "b", "dim"])

    found = both.repartition(*keys).sortWithinPartitions(*keys, "probe", "id").mapInArrow(run, "a long, b long, dim int")
    need = F.least(F.lit(AGREE), F.ceil(F.col("dim") / F.lit(BLOCK_WIDTH)))
    return found.groupBy("a", "b", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select("a", "b")


def verified(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """Those pairs whose cosine, in double precision, is at least ``cosine``."""
    v = reps.select("id", "v")
    both = (pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
            .join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb"))

    def run(batches):
        for batch in batches:
            va, vb = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
            x = [np.frombuffer(p, "<f8") for p in va]
            y = [np.frombuffer(p, "<f8") for p in vb]
            cos = np.array([p @ q / np.sqrt((p @ p) * (q @ q)) for p, q in zip(x, y)])
            yield batch.select(["a", "b"]).filter(pa.array(cos >= cosine))

    return both.mapInArrow(run, "a long, b long")


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row ``(id, n_links, component_id, kept)`` per row of ``df``.

    ``n_links`` counts the other rows with cosine >= ``cosine``; ``component_id`` is the smallest id reachable by links.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing (0 links, own id); vectors
    of different lengths never link. Equal vectors are one class, so copies are not expanded into pairs; rows that repeat
    an id count as rows of their own. An empty table gives no rows; other columns are not looked at.
    """
    bound_batches(df.sparkSession)
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be in (0, 1]")
    limit = 2 - 2 * cosine
    rows = stored(usable(df, id_col, vector_col), "vectors")
    good = rows.where("v is not null and id is not null")
    reps = stored(good.groupBy("dim", "v").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                  .withColumn("id", F.monotonically_increasing_id()), "reps")
    links = stored(verified(candidates(reps, limit), reps, cosine), "links")
    found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "id")
    firsts = found.join(reps.select("id", "first_id"), "id").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = found.join(firsts, "component").select("id", "component_id")
    size = reps.select(F.col("id").alias("b"), "copies")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(size, "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "id")
    labelled = stored(reps.join(degree, "id", "left").join(named, "id", "left")
                      .select("dim", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                              F.coalesce("component_id", "first_id").alias("component_id")), "labels")
    linked = good.join(labelled, ["dim", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
