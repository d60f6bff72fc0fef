"""Shared inputs of the catalog queries: fixture observations and the latest state per true entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import current_state
from ..sources.fixture import AS_OF, OBS_COLUMNS, blanks_to_null, observations, read_table  # noqa: F401
from ..sources.snapshots import scratch_path, write_observation_table

ENTITY = "p_partkey"


_MATERIALISED: dict[tuple[str, str], str] = {}
_PROPERTIES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference-shaped observations (blank strings kept), stored once per session as a parquet table
    partitioned by scan_date in the shared checkpoint folder (the observation store). Reading the stored
    table keeps obs_seq identical across jobs and gives scan_date partition pruning."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _MATERIALISED.get(key)
    if path is None:
        path = write_observation_table(observations(spark, sf_dir), f"obs-{abs(hash(sf_dir))}")
        _MATERIALISED[key] = path
    return spark.read.parquet(path).select(*OBS_COLUMNS)


def obsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with blank strings as nulls (absent keys)."""
    return blanks_to_null(obs(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the observations (D4, ``label_rows``), stored once per session."""
    from ..operators.resolve import key_rows, label_rows

    key = (spark.sparkContext.applicationId, "resolved:" + sf_dir)
    path = _MATERIALISED.get(key)
    if path is None:
        path = label_rows(key_rows(obsn(spark, sf_dir))).stored_path
        _MATERIALISED[key] = path
    return spark.read.parquet(path)


def resolved(spark: SparkSession, sf_dir: str, only: list | None = None) -> DataFrame:
    """The observations with their resolved entity (D4), those of the entities ``only`` if given. The labels are joined when it is read, so
    that a reader shuffles the columns that it uses."""
    from ..operators.resolve import attach_labels
    from ..session import stored

    lab = labels(spark, sf_dir)
    if only is not None:
        lab = stored(lab.where(F.col("entity_id").isin(only)), "some")  # of a known size, so that few rows are sent to the observations
    return attach_labels(obsn(spark, sf_dir), lab)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state per true entity (F4 keyed by p_partkey)."""
    return current_state(obsn(spark, sf_dir), ENTITY)


def publish(spark: SparkSession, sf_dir: str, geocode=None, schemes=None) -> DataFrame:
    """A6 computed from the observations (no lookup caches unless given)."""
    from ..plans.publish import publish_listings

    return publish_listings(obsn(spark, sf_dir), state(spark, sf_dir), ENTITY, AS_OF, geocode, schemes)


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published listing table as the dashboard queries read it: A6 written once per session as
    parquet in the shared checkpoint folder, then read back by every consumer query."""
    key = (spark.sparkContext.applicationId, "published:" + sf_dir)
    path = _MATERIALISED.get(key)
    if path is None:
        path = scratch_path(spark, "published")
        publish(spark, sf_dir).write.mode("overwrite").parquet(path)
        _MATERIALISED[key] = path
    return spark.read.parquet(path)


def properties_raw(spark: SparkSession, sf_dir: str):
    """Input of the dedup: the property database as the replay leaves it, one entry per (p_partkey,
    listing_id) of the observations (last values, first/last dates) and its price / auction-date points with
    their position. Stored once per session in the shared checkpoint folder (the database file of the
    reference), then read by every dedup query. Entries and points come from one pass, in which the observations are put by entry once."""
    from pyspark.sql import functions as F

    from ..operators.history import state_and_points

    key = (spark.sparkContext.applicationId, "properties_raw:" + sf_dir)
    if key not in _PROPERTIES:
        o = obsn(spark, sf_dir).withColumn(
            "entry_id", F.concat_ws("|", F.col("p_partkey").cast("string"), F.coalesce(F.col("listing_id"), F.lit("")))
        )
        _PROPERTIES[key] = state_and_points(o, "entry_id", extra=("p_partkey",))
    entries, points = _PROPERTIES[key]
    entries = entries.withColumnRenamed("first_obs_seq", "arrival")
    where = ("entry_id", "scan_date", "obs_seq")
    return (entries, points.where("price_pos is not null").select(*where, "price", "date", "url", F.col("price_pos").alias("pos")),
            points.where("auction_date_pos is not null").select(*where, "auction_date", "date", F.col("auction_date_pos").alias("pos")))


# ---------------------------------------------------------------------------------------------------------
# Lookup tables for the enrichment queries, derived from the observations: earlier runs resolved the addresses
# of one region (postcodes up to a bound); addresses elsewhere are not cached yet.

def _addresses(spark, sf_dir, max_postcode: int):
    """Addresses of the entities whose postcode is at most ``max_postcode`` (the region earlier runs covered)."""
    from pyspark.sql import functions as F

    st = state(spark, sf_dir)
    a = (st.select(F.trim(F.coalesce(F.col("header_full"), F.lit(""))).alias("address"))
         .filter(F.length("address") > 5).distinct())
    return a.filter(_postcode_num(F.col("address")).between(1, max_postcode))


def _postcode_num(c):
    from pyspark.sql import functions as F

    from ..functions import extract_postcode
    return F.coalesce(extract_postcode(c).try_cast("int"), F.lit(0))


def geocode_cache(spark, sf_dir):
    """(address, lat, lng, q) for addresses with postcode <= 41000."""
    from pyspark.sql import functions as F

    a = _addresses(spark, sf_dir, 41000)
    pc = _postcode_num(F.col("address"))
    q = F.element_at(F.array(*[F.lit(x) for x in ("full", "postcode", "state", "default")]), (pc % 4 + 1).cast("int"))
    return a.select("address", (F.lit(3.0) + (pc % 100) / 1000.0).alias("lat"), (F.lit(101.0) + (pc % 700) / 1000.0).alias("lng"), q.alias("q"))


def gazetteer(spark, sf_dir):
    """(kind, key, lat, lng): full addresses with postcode <= 41300, 'postcode, state' of addresses with
    postcode <= 41600, and every state."""
    from pyspark.sql import functions as F

    from ..functions import STATES, extract_postcode, extract_state
    full = _addresses(spark, sf_dir, 41300)
    pc = _postcode_num(F.col("address"))
    f = full.select(F.lit("full").alias("kind"), F.col("address").alias("key"),
                    (F.lit(3.5) + (pc % 100) / 1000.0).alias("lat"), (F.lit(101.5) + (pc % 700) / 1000.0).alias("lng"))
    mid = _addresses(spark, sf_dir, 41600)
    p = mid.select(F.concat_ws(", ", extract_postcode("address"), extract_state("address")).alias("key"),
                   _postcode_num(F.col("address")).alias("_pc")).filter(F.col("key").contains(",")).distinct()
    p = p.select(F.lit("postcode").alias("kind"), "key", (F.lit(2.5) + (F.col("_pc") % 100) / 1000.0).alias("lat"),
                 (F.lit(102.0) + (F.col("_pc") % 700) / 1000.0).alias("lng"))
    states = spark.createDataFrame([(s, 1.0 + i / 10.0, 100.0 + i / 10.0) for i, s in enumerate(STATES)], "key string, lat double, lng double")
    s = states.select(F.lit("state").alias("kind"), "key", "lat", "lng")
    return f.unionByName(p).unionByName(s)


def scheme_cache(spark, sf_dir):
    """(address, scheme) for addresses with postcode <= 41000: 'Taman <brand number>' for odd brand numbers,
    '' (tried, none found) for even ones."""
    from pyspark.sql import functions as F

    a = _addresses(spark, sf_dir, 41000)
    b = F.regexp_extract("address", r"Brand#(\d+)", 1)
    return a.select("address", F.when(b.try_cast("int") % 2 == 1, F.concat(F.lit("Taman "), b)).otherwise(F.lit("")).alias("scheme"))


def scheme_responses(batches):
    """Model answers per request batch: 'NONE' for placeholder titles, else '<first word> Residences'; every
    3rd batch wrapped in a code fence, every 5th one element short (rejected)."""
    from pyspark.sql import functions as F

    lines = F.split(F.col("request_text"), "\n")
    titles = F.transform(lines, lambda l: F.regexp_replace(l, r"^\d+\.\s", ""))
    names = F.transform(titles, lambda t: F.when(t.startswith("Property Listing"), F.lit("NONE"))
                        .otherwise(F.concat(F.split(t, " ")[0], F.lit(" Residences"))))
    names = F.when(F.col("batch_id") % 5 == 4, F.slice(names, 1, F.size(names) - 1)).otherwise(names)
    js = F.to_json(names)
    text = F.when(F.col("batch_id") % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js)
    return batches.select("batch_id", text.alias("response_text"))
