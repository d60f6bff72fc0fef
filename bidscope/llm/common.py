"""Helpers shared by the operators: stored intermediate tables, Arrow batch maps, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidscope.session import checkpoint_dir, ship_package

#: Bytes in one Arrow batch handed to Python: texts can be long, and a worker holds a few copies of a batch.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor loses nothing that was written) with columnar,
    compressed files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads, once what was made of them is stored itself."""
    for t in tables:
        folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bound_batches(spark: SparkSession) -> None:
    """Before Python runs on the executors: send them the package, and use Arrow batches of ``BATCH_BYTES`` at most where
    the session has Spark's default."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def _trim() -> None:
    """Return what the allocators of this process hold free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving memory back when a task ends: Spark keeps its Python workers, and with them what they once took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidied


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Append ``fields`` computed batch by batch; a column of the same name (any case) is replaced.

    ``make`` runs once per task and returns the function from a batch to one array per field.
    """
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *fields])
    out_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *work(b)], names=out_names)

    return df.mapInArrow(tidy(run), schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(src, dst)`` (longs): one row ``(node, component)`` per node that has an
    edge to another node, ``component`` being the smallest node reachable.

    Alternating large-star and small-star rounds: every round is two aggregates by node with a join back, so
    a node with very many neighbours is an ordinary skewed join key, never a collected list. Rounds are
    written to the shared folder; the loop stops when a round leaves the edge set as it was.
    """
    e = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).where("u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.xxhash64("v", "u") % 1000003)))
    before = e.select(sign.alias("s")).first()["s"]
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
                 .select("p.u", "p.v").where("u <> v").distinct())
        e = stored(small, "cc")
        now = e.select(sign.alias("s")).first()["s"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: its cleaner acts when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
