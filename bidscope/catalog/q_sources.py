"""Catalog: snapshot, observation-store and state round trips (A1, A2, A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import snapshots as S
from . import context as C
from .registry import register

ROUND_COLS = ("scan_date", "title", "location", "size", "header_short", "header_full", "listing_id", "price",
              "auction_date", "discount", "last_updated", "price_value")


@register("a1_snapshot_roundtrip", "A1", views=("obs",), sql=f"SELECT {', '.join(ROUND_COLS)} FROM obs")
def a1_snapshot_roundtrip(spark, sf_dir):
    o = C.obs(spark, sf_dir).withColumn("raw_id", F.col("obs_seq").cast("string"))
    path = S.scratch_path(spark, "snapshots")
    S.write_snapshot_json(o, path)
    back = S.read_snapshots(spark, path, multi_line=False)
    return back.select(*ROUND_COLS)


@register("a2_snapshot_replace_scan", "A2", views=("obs",), sql="""
SELECT scan_date, count(*) AS n FROM obs
WHERE scan_date <> (SELECT max(scan_date) FROM obs) OR discount <> ''
GROUP BY 1""")
def a2_snapshot_replace_scan(spark, sf_dir):
    o = C.obs(spark, sf_dir)
    last = o.agg(F.max("scan_date").alias("d")).first()["d"]
    path = S.scratch_path(spark, "obs-store")
    S.write_snapshot(o, path)
    # a second scan on the same day replaces the first one (dynamic partition overwrite)
    S.write_snapshot(o.filter((F.col("scan_date") == F.lit(last)) & (F.col("discount") != "")), path)
    return S.read_observations(spark, path).groupBy("scan_date").agg(F.count(F.lit(1)).alias("n"))


@register("a3_properties_roundtrip", "A3, F4", views=("state",), sql="""
SELECT p_partkey, title, price, auction_date, n_obs FROM state""")
def a3_properties_roundtrip(spark, sf_dir):
    st = C.state(spark, sf_dir)
    base = S.scratch_path(spark, "properties")
    v1 = S.write_properties(st, base)
    back = S.read_properties(spark, v1, st.schema)
    return back.select("p_partkey", "title", "price", "auction_date", "n_obs")
