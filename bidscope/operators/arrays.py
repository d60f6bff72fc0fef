"""Array, record and JSON helpers (I1-I4) as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col

PLACEHOLDER = "Property Listing"


def append_history(arr, item: Column) -> Column:
    """Append a struct to an array column, creating the array when absent."""
    a = col(arr)
    return F.concat(F.coalesce(a, F.array_repeat(item, 0)), F.array(item))


def slice_last(arr, k: int) -> Column:
    """The last k elements (the whole array when shorter; empty stays empty)."""
    a = col(arr)
    return F.slice(a, F.greatest(F.size(a) - F.lit(k) + 1, F.lit(1)), k)


def merge_records(old: DataFrame, new: DataFrame, key: str, fields) -> DataFrame:
    """The new record overrides the old one where it carries a value; a placeholder title on the new
    side keeps the original title. Both inputs have one row per key."""
    o = old.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    n = new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    j = o.join(n, key, "full_outer")
    out = []
    for f in fields:
        v = F.coalesce(F.col(f"_n_{f}"), F.col(f"_o_{f}"))
        if f == "title":
            v = F.when(F.coalesce(F.col("_n_title"), F.lit("")).startswith(PLACEHOLDER) & F.col("_o_title").isNotNull(),
                       F.col("_o_title")).otherwise(v)
        out.append(v.alias(f))
    return j.select(key, *out)


def export_json(df: DataFrame, key: str, fields) -> DataFrame:
    """I4: one compact JSON text per row (key, json); the reference's id-keyed object becomes rows."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in fields])).alias("json"))
