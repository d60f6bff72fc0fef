"""Publish: the compact listing table, latest change set and KPI row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    clean_location, format_amount, is_valid_price, listing_search_text, price_value, resolve_scheme,
    round_coord, short_address, strip_weekday,
)
from ..operators.history import change_points, history_rounds, recent_prices
from ..operators.predicates import is_active, is_expired


def _opt(df: DataFrame, c: str, typ: str = "string"):
    return F.col(c) if c in df.columns else F.lit(None).cast(typ)


def display_price(price, pv, last_valid_ph_price) -> tuple:
    """(display price, price value). Current price when valid (B13); else the last valid history price
    (and its value); else 'RM{pv:,}' when pv >= 10,000; else the raw price."""
    valid_now = is_valid_price(price)
    p = (
        F.when(valid_now, price)
        .when(last_valid_ph_price.isNotNull(), last_valid_ph_price)
        .when(F.coalesce(pv, F.lit(0)) >= 10_000, format_amount(pv))
        .otherwise(F.coalesce(price, F.lit("")))
    )
    v = F.when(~valid_now & last_valid_ph_price.isNotNull(), price_value(last_valid_ph_price)).otherwise(F.coalesce(pv, F.lit(0)))
    return p, v


def one_per_address(cache: DataFrame, *cols: str) -> DataFrame:
    """A cache keyed by trimmed address, one row per address (of several the smallest), so that joins do not fan out."""
    row = F.min(F.struct(*cols)).alias("r")
    return cache.groupBy(F.trim("address").alias("_addr")).agg(row).where("_addr <> ''").select("_addr", "r.*")


def publish_listings(obs: DataFrame, state: DataFrame, entity: str, as_of, geocode: DataFrame | None = None,
                     schemes: DataFrame | None = None) -> DataFrame:
    """One compact row per entity (active and expired) with ``is_expired`` (C2), cleaned location (B14),
    auction text without weekday, short address, display price (F10), the last 5 valid price points (F9) as
    ``ph`` and the merged history rounds (F8) as ``hist``, coordinates from the geocode cache (D6, quality
    'default' ignored) and the scheme (D7/B21). ``search_text`` (B24) is materialised for the listing query.

    ``obs`` are the entity-labelled observations the state was built from; ``geocode`` is
    (address, lat, lng, q) and ``schemes`` is (address, scheme), both optional lookup tables."""
    lu = state.select(entity, F.col("listing_url") if "listing_url" in state.columns else F.lit(None).cast("string").alias("listing_url"))
    pp, ap = change_points(obs, entity)
    recent = recent_prices(pp, entity, lu)
    rounds = history_rounds(pp, ap, entity, lu)

    ph = recent.groupBy(entity).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("price").alias("p"), F.col("day").alias("d"), F.col("url").alias("u")))).alias("ph"),
        F.max_by("price", "pos").alias("_last_valid_price"),
    )
    hist = rounds.groupBy(entity).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("day").alias("d"), F.col("price").alias("p"),
                                             F.col("auction_date").alias("ad"), F.col("url").alias("u")))).alias("hist")
    )
    s = state.join(ph, entity, "left").join(hist, entity, "left")
    addr_key = F.trim(F.coalesce(F.col("header_full"), F.lit("")))
    # a listing without address gets a key of its own: such rows spread out and match nothing
    s = s.withColumn("_addr", F.coalesce(F.nullif(addr_key, F.lit("")), F.concat(F.lit("\u0002"), F.col(entity).cast("string"))))
    if geocode is not None:
        g = one_per_address(geocode, "lat", "lng", "q")
        s = s.join(g, "_addr", "left")
        lat = F.when(F.col("q") != "default", round_coord("lat"))
        lng = F.when(F.col("q") != "default", round_coord("lng"))
    else:
        lat = F.lit(None).cast("double")
        lng = F.lit(None).cast("double")
    if schemes is not None:
        sc = one_per_address(schemes, "scheme").withColumnRenamed("scheme", "_cached_scheme")
        s = s.join(sc, "_addr", "left")
        cached = F.col("_cached_scheme")
    else:
        cached = F.lit(None).cast("string")

    price, pv = display_price(F.col("price"), F.col("price_value"), F.col("_last_valid_price"))
    out = s.select(
        entity,
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        price.alias("price"),
        pv.alias("price_value"),
        clean_location("location").alias("location"),
        F.coalesce(F.col("size"), F.lit("")).alias("size"),
        strip_weekday("auction_date").alias("auction_text"),
        F.col("auction_date"),
        F.coalesce(F.col("property_type"), F.lit("")).alias("property_type"),
        F.coalesce(F.col("discount"), F.lit("")).alias("discount"),
        F.coalesce(_opt(s, "listing_url"), F.lit("")).alias("listing_url"),
        F.coalesce(_opt(s, "image_url"), F.lit("")).alias("image_url"),
        short_address("header_full").alias("address"),
        F.coalesce(F.col("ph"), F.array()).alias("ph"),
        F.coalesce(F.col("hist"), F.array()).alias("hist"),
        lat.alias("lat"),
        lng.alias("lng"),
        resolve_scheme(cached, _opt(s, "scheme_name"), "header_short", "header_full", "title").alias("scheme_name"),
        is_expired(as_of).alias("is_expired"),
        is_active(as_of).alias("is_active"),
        F.col("first_obs_seq").alias("arrival"),
    )
    return out.withColumn(
        "search_text", listing_search_text("title", "address", "location", "property_type", "price", "size")
    )
