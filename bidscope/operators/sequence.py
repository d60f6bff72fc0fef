"""Order-consistent sequence numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_sequence(df: DataFrame, order_cols, name: str = "obs_seq", num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: a unique bigint that increases with ``order_cols`` (a total order).

    The rows are range-partitioned on the order columns and sorted inside each partition, so
    ``monotonically_increasing_id`` (partition index in the high bits, position in the low bits) is
    increasing in the global order. The numbers are not dense; only their order is used downstream.
    Work is spread over ``num_partitions`` tasks instead of one task holding the whole table.
    Range bounds are sampled per job, so the numbers are stable only within one job: materialise the result
    (a written table or a checkpoint) before using it in more than one job.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    return ranged.withColumn(name, F.monotonically_increasing_id())


def dense_index(df: DataFrame, order_cols, name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``order_cols`` (ties broken by the full row order of the columns
    given; pass a total order). Distributed: rows are range-partitioned and sorted inside each partition,
    the result is stored (range bounds are sampled per job, so the partitioning is fixed once; in columns and compressed, where a
    checkpoint would hold whole rows as they are), then per-partition counts (one row per partition) give each partition its offset."""
    from ..session import stored

    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    ranged = stored(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    # one row per partition: the window and the broadcast are bounded by the partition count
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    out = ranged.join(F.broadcast(offs), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + local + 1).drop("_pid", "_mid", "_off")


def rank_in_group(df: DataFrame, group: str, seq: str, name: str = "rank") -> DataFrame:
    """Add ``name`` = 0..n-1 in the order of ``seq`` within every ``group``, and ``group_size``.

    The numbers of :func:`order_sequence` run on without gaps within a partition, so where the rows of a group in one block of numbers
    (the bits above 33) are as many as the numbers that they span, their places follow from one count per group and block: nothing is
    shuffled but those counts, and the rows keep the order in which they are read. Other numbers are put in order by :func:`dense_index`."""
    from pyspark.sql import Window

    from ..session import stored

    rows = df.select(group, seq, F.shiftright(seq, 33).alias("_block"))
    blocks = stored(rows.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first"), F.max(seq).alias("_last")), "blocks")
    total = F.sum("_n").over(Window.partitionBy(group))
    if blocks.where(F.col("_last") - F.col("_first") + 1 != F.col("_n")).isEmpty():
        # one row per group and block: as many as the files of the table
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), (before - F.col("_first")).alias("_off"), total.alias("group_size"))
        out = df.join(F.broadcast(at), (F.col(group) == F.col("_g")) & (F.shiftright(seq, 33) == F.col("_b")))
        return out.withColumn(name, F.col(seq) + F.col("_off")).drop("_g", "_b", "_off")
    index = dense_index(df.select(group, seq), [group, seq], "_i")
    sizes = index.groupBy(group).agg(F.min("_i").alias("_f"), F.count(F.lit(1)).alias("group_size"))
    places = index.join(sizes, group).select(F.col(seq).alias("_s"), (F.col("_i") - F.col("_f")).alias(name), "group_size")
    return df.join(places, F.col(seq) == F.col("_s")).drop("_s")
