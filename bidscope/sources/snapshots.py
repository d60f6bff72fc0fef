"""Snapshot, state and scan-log storage (A1-A4).

Observations are stored as parquet partitioned by ``scan_date`` (one partition per scan; a second scan on the
same day replaces the first through dynamic partition overwrite). Snapshot JSON files in the reference layout
(``{scan_date, scraping_stats, properties: {raw_id: listing}}``) are read with a declared schema.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LISTING, SNAPSHOT
from ..operators.sequence import rank_in_group
from ..session import checkpoint_dir
from . import versions


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/bidscope/{name}-{uuid.uuid4().hex[:12]}"


def write_observation_table(obs: DataFrame, name: str) -> str:
    """Write observations once as parquet partitioned by scan_date; return the path."""
    path = scratch_path(obs.sparkSession, name)
    obs.write.mode("overwrite").partitionBy("scan_date").option("compression", "zstd").parquet(path)
    return path


def write_snapshot(obs: DataFrame, path: str) -> None:
    """A2: write scans as scan_date partitions; re-writing a scan date replaces only that scan."""
    (obs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("scan_date").parquet(path))


def read_observations(spark: SparkSession, path: str, scans=None) -> DataFrame:
    """Read stored observations; ``scans`` (list of dates) prunes partitions."""
    df = spark.read.parquet(path)
    if scans is not None:
        df = df.filter(F.col("scan_date").isin(list(scans)))
    return df


def write_snapshot_json(obs: DataFrame, path: str, raw_id_col: str = "raw_id", rows_per_doc: int = 5000) -> None:
    """Write scans in the reference's snapshot layout: JSON documents {scan_date, properties: {raw_id:
    listing}}. Each scan is split by a hash of raw_id into ceil(rows / rows_per_doc) documents (a snapshot is
    the union of its documents), so no document and no task holds more than about rows_per_doc listings."""
    fields = [f.name for f in LISTING.fields if f.name in obs.columns]
    # one row per scan: the number of documents of that scan
    n_docs = obs.groupBy("scan_date").agg(F.ceil(F.count(F.lit(1)) / rows_per_doc).cast("long").alias("_nd"))
    obs = obs.join(n_docs, "scan_date")
    part = F.pmod(F.xxhash64(F.col(raw_id_col).cast("string")), F.col("_nd")).alias("_p")
    doc = obs.select("scan_date", part, F.col(raw_id_col).cast("string").alias("_rid"), F.struct(*fields).alias("_l")) \
        .groupBy("scan_date", "_p").agg(F.map_from_entries(F.collect_list(F.struct("_rid", "_l"))).alias("properties"))
    out = doc.select(F.date_format("scan_date", "yyyy-MM-dd'T'HH:mm:ss").alias("scan_date"), "properties",
                     F.col("scan_date").alias("_d"), "_p")
    # a document is one row already, so nothing is shuffled again; gzip, since the text repeats every name for every listing
    out.write.mode("overwrite").partitionBy("_d", "_p").option("compression", "gzip").json(path)


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A1: read every snapshot document with a declared schema (PERMISSIVE: unreadable documents become
    rows with only _corrupt_record and are skipped), one row per listing with scan_date, its position in the document and raw_id.
    ``multi_line`` reads pretty-printed documents (one per file, the reference's files); False reads one
    document per line. Order comes from the scan date (documents are named by date in the reference)."""
    raw = (spark.read.schema(SNAPSHOT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("multiLine", multi_line).option("recursiveFileLookup", True).json(path))
    ok = raw.filter(F.col("_corrupt_record").isNull() & F.col("scan_date").isNotNull())
    ex = ok.select(F.to_date(F.substring("scan_date", 1, 10)).alias("scan_date"),
                   F.posexplode("properties").alias("position", "raw_id", "p"))
    return ex.select("scan_date", "position", "raw_id", "p.*")


def write_snapshot_files(obs: DataFrame, path: str, order_col: str = "obs_seq", rows_per_doc: int = 5000) -> None:
    """Write scans as snapshot documents in arrival order: ``scan_date=<day>/part=<number>`` with ``rows_per_doc`` listings each (gzip), in the
    order of ``order_col`` (the position of a listing in its document, and of a document in its scan)."""
    fields = [f.name for f in LISTING.fields if f.name in obs.columns]
    # places follow from counts, and the rows are shuffled once, by document, with their number as the key of their place and their id
    doc = rank_in_group(obs.select("scan_date", order_col, F.struct(*fields).alias("_l")), "scan_date", order_col, "_i").select(
        "scan_date", F.lpad(F.floor(F.col("_i") / rows_per_doc).cast("string"), 9, "0").alias("part"), F.struct(F.col(order_col).alias("_rid"), "_l").alias("_e"))
    doc = doc.groupBy("scan_date", "part").agg(F.sort_array(F.collect_list("_e")).alias("_a"))
    properties = F.map_from_entries(F.transform("_a", lambda x: F.struct(x["_rid"].cast("string"), x["_l"])))
    out = doc.select(F.date_format("scan_date", "yyyy-MM-dd'T'HH:mm:ss").alias("scan_date"), properties.alias("properties"), F.col("scan_date").alias("_d"), "part")
    out = out.withColumn("_line", F.to_json(F.struct("scan_date", "properties"))).select("_line", F.col("_d").alias("scan_date"), "part")
    # a document is one row already; gzip, since the text repeats every name for every listing
    out.write.partitionBy("scan_date", "part").option("compression", "gzip").text(path)


def read_snapshot_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A1: the listings of snapshot files with ``scan_date``, ``document`` (the file), ``position`` in it and ``raw_id``. Unreadable
    documents give no rows."""
    raw = (spark.read.schema(SNAPSHOT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", True).json(paths))
    ok = raw.select("*", F.col("_metadata.file_path").alias("document")).filter(F.col("_corrupt_record").isNull() & F.col("scan_date").isNotNull())
    ex = ok.select(F.to_date(F.substring("scan_date", 1, 10)).alias("scan_date"), "document", F.posexplode("properties").alias("position", "raw_id", "p"))
    return ex.select("scan_date", "document", "position", "raw_id", "p.*")


def read_properties(spark: SparkSession, path: str, schema) -> DataFrame:
    """A3: the state table; a missing table reads as empty with the declared schema. Any other failure (no access, an
    unknown file system) is raised: an outage must not look like an empty state."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_properties(df: DataFrame, base_path: str) -> str:
    """A3: full overwrite by writing a new version folder (never the path being read) and returning it;
    the caller switches its pointer to the returned path."""
    path = f"{base_path.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return path


def commit_properties(df: DataFrame, base: str, keep: int = 2) -> versions.Version:
    """A3: full overwrite behind the version pointer: the data is written to a new folder, then the pointer moves by a rename. A writer
    that dies in between leaves the old state; readers of the last ``keep`` versions go on undisturbed, older ones are deleted."""
    spark = df.sparkSession
    before = versions.current(spark, base)
    folder = versions.new_folder(base, "properties")
    df.write.parquet(folder)
    done = versions.commit(spark, base, before, {"properties": folder})
    versions.retire(spark, base, keep)
    return done


def current_properties(spark: SparkSession, base: str, schema) -> DataFrame:
    """A3: the committed state table; empty with the declared schema before the first commit."""
    return versions.read_part(spark, versions.current(spark, base), "properties", schema)


def write_scan_log(log: DataFrame, path: str) -> None:
    """A4: add one log entry per scan (scan_date partitions). Writing a scan again replaces its entry
    (dynamic partition overwrite), so a re-run scan is logged once."""
    (log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("scan_date").parquet(path))


def read_scan_log(spark: SparkSession, path: str) -> DataFrame:
    """A4: the scan log, one row per scan."""
    return spark.read.parquet(path)
