"""Enrichment through lookup tables.

The network lookups of the reference (geocoder, language model) are replaced by tables: a gazetteer for the
geocoding chain and response tables for the scheme and market answers. Caches are joined, never looped over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract_postcode, extract_state
from .sequence import dense_index

# Default map centre and geocode qualities.
DEFAULT_LAT = 3.1390
DEFAULT_LNG = 101.6869
QUALITIES = ("full", "postcode", "state", "default")


def uncached(candidates: DataFrame, cache: DataFrame, key: str = "address") -> DataFrame:
    """Candidate keys not yet in the cache (anti join)."""
    return candidates.join(cache.select(key), key, "left_anti")


def geocode_by_gazetteer(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Full address -> 'postcode, state' -> state -> default centre, with the quality reached.
    ``gazetteer`` is (kind, key, lat, lng) with kind in full / postcode / state; each kind is reduced to one
    row per key before its left join, so no join fans out."""
    g = gazetteer.groupBy("kind", "key").agg(F.min(F.struct("lat", "lng")).alias("_p")).select("kind", "key", "_p.lat", "_p.lng")
    full = g.filter(F.col("kind") == "full").select(F.col("key").alias("_fk"), F.col("lat").alias("_flat"), F.col("lng").alias("_flng"))
    pc = g.filter(F.col("kind") == "postcode").select(F.col("key").alias("_pk"), F.col("lat").alias("_plat"), F.col("lng").alias("_plng"))
    st = g.filter(F.col("kind") == "state").select(F.col("key").alias("_sk"), F.col("lat").alias("_slat"), F.col("lng").alias("_slng"))
    a = addresses.select("address", extract_postcode("address").alias("_postcode"), extract_state("address").alias("_state"))
    a = a.join(full, a["address"] == full["_fk"], "left")
    a = a.join(pc, F.concat_ws(", ", a["_postcode"], a["_state"]) == pc["_pk"], "left")
    a = a.join(st, a["_state"] == st["_sk"], "left")
    q = (F.when(F.col("_fk").isNotNull(), "full").when(a["_postcode"].isNotNull() & F.col("_pk").isNotNull(), "postcode")
         .when(F.col("_sk").isNotNull(), "state").otherwise("default"))
    lat = (F.when(F.col("_fk").isNotNull(), F.col("_flat")).when(a["_postcode"].isNotNull() & F.col("_pk").isNotNull(), F.col("_plat"))
           .when(F.col("_sk").isNotNull(), F.col("_slat")).otherwise(F.lit(DEFAULT_LAT)))
    lng = (F.when(F.col("_fk").isNotNull(), F.col("_flng")).when(a["_postcode"].isNotNull() & F.col("_pk").isNotNull(), F.col("_plng"))
           .when(F.col("_sk").isNotNull(), F.col("_slng")).otherwise(F.lit(DEFAULT_LNG)))
    return a.select("address", lat.alias("lat"), lng.alias("lng"), q.alias("q"))


def geocode_quality(cache: DataFrame) -> DataFrame:
    """Cache entries per quality."""
    return cache.groupBy("q").agg(F.count(F.lit(1)).alias("n"))


def scheme_coverage(cache: DataFrame) -> DataFrame:
    """Named vs unnamed scheme cache entries."""
    return cache.groupBy(F.when(F.coalesce(F.col("scheme"), F.lit("")) != "", "named").otherwise("unnamed").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


BATCH_SIZE = 50  # fixed value: titles per request


def scheme_request_batches(candidates: DataFrame, size: int = BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """Number the (address, title) candidates 1..n in address order (an exact, distributed numbering),
    cut them into batches of ``size`` and build one numbered request text per batch (bounded groups).
    Returns (numbered candidates with batch_id and pos, batches with n_titles and request_text)."""
    numbered = dense_index(candidates, ["address"], "idx")
    numbered = numbered.select(
        "address", "title", ((F.col("idx") - 1) / size).cast("long").alias("batch_id"),
        ((F.col("idx") - 1) % size + 1).cast("int").alias("pos"),
    )
    batches = numbered.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_titles"),
        F.sort_array(F.collect_list(F.struct("pos", F.concat(F.col("pos").cast("string"), F.lit(". "), F.col("title")).alias("line")))).alias("_l"),
    ).select("batch_id", "n_titles", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("request_text"))
    return numbered, batches


def strip_fences(c) -> F.Column:
    """Code fences around a model answer removed (a leading ```json and a trailing ```)."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")


def apply_scheme_responses(numbered: DataFrame, batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Per batch parse the answer (fences stripped) as a JSON array of strings; accept it only when its
    length equals the batch size, else every title of the batch gets ''. 'NONE', null and failures -> ''.
    Returns new cache rows (address, scheme)."""
    r = responses.select("batch_id", F.from_json(strip_fences(F.col("response_text")), "array<string>").alias("_arr"))
    b = batches.select("batch_id", "n_titles").join(r, "batch_id", "left")
    b = b.withColumn("_ok", F.coalesce(F.size("_arr") == F.col("n_titles"), F.lit(False)))
    vals = b.filter("_ok").select("batch_id", F.posexplode("_arr").alias("_p", "_v")).select(
        "batch_id", (F.col("_p") + 1).alias("pos"), "_v")
    j = numbered.join(vals, ["batch_id", "pos"], "left")
    scheme = F.when(F.col("_v").isNotNull() & (F.col("_v") != "NONE"), F.col("_v")).otherwise(F.lit(""))
    return j.select("address", scheme.alias("scheme"))


def merge_cache(cache: DataFrame, new_rows: DataFrame, key: str = "address") -> DataFrame:
    """Existing cache rows plus the new keys (an empty answer is cached as '' and not retried)."""
    return cache.unionByName(new_rows.join(cache.select(key), key, "left_anti"))


MARKET_LISTING = (
    "struct<sale_listings:array<struct<title:string,price:string,psf:string,size:string,beds:string,image:string,url:string>>,"
    "rental_listings:array<struct<title:string,price:string,psf:string,size:string,beds:string,image:string,url:string>>,"
    "summary:string>"
)


def market_listings(answers: DataFrame, key: str = "answer_id") -> tuple[DataFrame, DataFrame]:
    """Model answers -> (listing rows (key, kind, pos, fields), summaries (key, summary)). The answer is
    parsed with fences stripped; when that fails, the outermost {...} of the text is tried."""
    t = strip_fences(F.col("answer_text"))
    # from_json gives a struct of nulls (not null) for malformed text, so pick the parse by the text's shape
    whole = F.from_json(t, MARKET_LISTING)
    outer = F.from_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1), MARKET_LISTING)
    parsed = answers.select(key, F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$"), whole).otherwise(outer).alias("m"))
    sale = parsed.select(key, F.lit("sale").alias("kind"), F.posexplode("m.sale_listings").alias("pos", "l"))
    rent = parsed.select(key, F.lit("rental").alias("kind"), F.posexplode("m.rental_listings").alias("pos", "l"))
    rows = sale.unionByName(rent).select(key, "kind", (F.col("pos") + 1).alias("pos"), "l.*")
    return rows, parsed.select(key, F.col("m.summary").alias("summary"))
