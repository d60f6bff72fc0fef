"""As-of look-ups: the last value of a key before a position.

A window over a whole key puts a key that holds a third of the rows into one task. Keys above ``HOT_ROWS`` rows are therefore cut into blocks
of the sequence: a window runs inside each block, a second one over one summary row per block of the key. There are at most rows /
``HOT_ROWS`` such keys, so their names are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1 << 20
SEG_BITS = 20  # positions in a block of a hot key


def hot_keys(df: DataFrame, key: str, limit: int = HOT_ROWS) -> list:
    """The keys with more than ``limit`` rows."""
    return [r[0] for r in df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key).collect()]


def crowded(df: DataFrame, key: str, limit: int = HOT_ROWS) -> list:
    """:func:`hot_keys` for little shuffle: the keys are told from every 64th row (by a hash of the row) and counted then. A key of about
    ``limit`` rows that the look misses costs time, not rows."""
    part = max(1, min(64, limit >> 10))
    some = df.where(F.col(key).isNotNull())
    few = some.where(F.pmod(F.xxhash64("seq"), F.lit(part)) == 0) if part > 1 else some
    likely = [r[0] for r in few.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit // (2 * part)).select(key).collect()]
    return hot_keys(some.where(F.col(key).isin(likely)), key, limit) if likely else []


def last_before(df: DataFrame, key: str, seq: str, values: dict[str, Column], hot: list = (), inclusive: bool = False, seg_bits: int = SEG_BITS) -> DataFrame:
    """Add, for each ``name: value``, the value's last non-null one among the rows of the same ``key`` before the row in ``seq``
    order (or up to it, if ``inclusive``); null without one. ``seq`` is a bigint, unique within the key; keys are not null. The
    rows of ``hot`` keys are taken by blocks; the result is the same."""
    names, edge = list(values), 0 if inclusive else -1
    if not hot:
        w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, edge)
        return df.select(*df.columns, *(F.last(values[n], ignorenulls=True).over(w).alias(n) for n in names))
    rows = df.withColumn("_blk", F.when(F.col(key).isin(list(hot)), F.shiftright(F.col(seq), seg_bits)).otherwise(F.lit(0)))
    inside = Window.partitionBy(key, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, edge)
    blocks = rows.where(F.col(key).isin(list(hot))).groupBy(key, "_blk").agg(*(F.max_by(values[n], F.when(values[n].isNotNull(), F.col(seq))).alias(f"_b_{n}") for n in names))
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "_blk", *(F.last(f"_b_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in names))
    rows = rows.select("*", *(F.last(values[n], ignorenulls=True).over(inside).alias(f"_i_{n}") for n in names))
    out = rows.join(blocks, [key, "_blk"], "left")
    return out.select(*df.columns, *(F.coalesce(f"_i_{n}", f"_b_{n}").alias(n) for n in names))
