"""Market aggregates (E1-E10). All are groupBy aggregates with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import price_value_all


def market_summary(properties: DataFrame, type_col: str = "property_type", price_col: str = "price") -> DataFrame:
    """Per property type (missing -> 'Other'): count of all listings, and average / min / max over the
    listings with a price > 0 (price read by B12). Average over priced rows only (Q7); 0 when none.
    Ordered by count desc, type asc."""
    p = properties.select(
        F.coalesce(F.col(type_col), F.lit("Other")).alias("property_type"),
        price_value_all(price_col).alias("_p"),
    )
    priced = F.when(F.col("_p") > 0, F.col("_p"))
    agg = p.groupBy("property_type").agg(
        F.count(F.lit(1)).alias("listing_count"),
        F.count(priced).alias("priced_count"),
        F.coalesce(F.avg(priced), F.lit(0.0)).alias("avg_price"),
        F.coalesce(F.min(priced), F.lit(0.0)).alias("min_price"),
        F.coalesce(F.max(priced), F.lit(0.0)).alias("max_price"),
    )
    return agg.orderBy(F.desc("listing_count"), "property_type")


def type_share(active: DataFrame, type_col: str = "property_type") -> DataFrame:
    """Count and percentage of the total per type (null or '' -> 'Other'); the total is a window over the
    small per-type result, not over the listings."""
    counts = active.groupBy(F.coalesce(F.nullif(F.col(type_col), F.lit("")), F.lit("Other")).alias("property_type")).agg(
        F.count(F.lit(1)).alias("listing_count")
    )
    total = F.sum("listing_count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share_pct", F.round(F.col("listing_count") * 100.0 / total, 4))


def facet_values(published: DataFrame, type_col: str = "property_type", loc_col: str = "location") -> DataFrame:
    """Sorted distinct non-empty types and locations (one row). collect_set combines map-side and holds
    only distinct values (a few hundred facets), never the listings."""
    t = F.when(F.col(type_col) != "", F.col(type_col))
    loc = F.when(F.col(loc_col) != "", F.col(loc_col))
    return published.agg(F.sort_array(F.collect_set(t)).alias("types"), F.sort_array(F.collect_set(loc)).alias("locations"))
