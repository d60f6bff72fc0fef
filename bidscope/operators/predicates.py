"""Filters and predicates (C1-C16). Each returns a filtered DataFrame or a boolean Column; all are plain
Catalyst predicates, so they combine and push down like any other filter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    days_until, discount_value, norm_address, parse_auction_date, parse_date_anywhere, price_value_all, resolve_type_alias,
    size_number,
)
from ..functions._util import col


def _as_of_date(as_of) -> Column:
    return F.to_date(F.lit(as_of))


def auction_day(c="auction_date") -> Column:
    return parse_auction_date(c)


def is_active(as_of, c="auction_date") -> Column:
    """C1 predicate: auction date parsed and on or after the as_of day (today counts as active, Q1)."""
    return F.coalesce(auction_day(c) >= _as_of_date(as_of), F.lit(False))


def is_expired(as_of, c="auction_date") -> Column:
    """C2 predicate: auction date parsed and before the as_of day; undated listings are not expired (Q2)."""
    return F.coalesce(auction_day(c) < _as_of_date(as_of), F.lit(False))


def active(df: DataFrame, as_of, c="auction_date") -> DataFrame:
    """Listings whose auction is on or after as_of."""
    return df.filter(is_active(as_of, c))


def with_expired_flag(df: DataFrame, as_of, c="auction_date") -> DataFrame:
    """Add ``is_expired`` and ``is_active`` (undated is neither)."""
    return df.withColumn("is_expired", is_expired(as_of, c)).withColumn("is_active", is_active(as_of, c))


def status(df: DataFrame, which: str = "active") -> DataFrame:
    """C3: 'all', 'active' (not expired, undated included, as the dashboard shows) or 'expired'."""
    if which == "active":
        return df.filter(~F.col("is_expired"))
    if which == "expired":
        return df.filter(F.col("is_expired"))
    return df


def price_between(df: DataFrame, lo: int = 0, hi: int = 0, c="price_value") -> DataFrame:
    """C4: either bound 0 = open; null price counts as 0."""
    pv = F.coalesce(col(c), F.lit(0))
    if lo and lo > 0:
        df = df.filter(pv >= lo)
    if hi and hi > 0:
        df = df.filter(pv <= hi)
    return df


def size_between(df: DataFrame, lo: float = 0, hi: float = 0, c="size") -> DataFrame:
    """With any bound set, rows without a size number are dropped."""
    if not ((lo and lo > 0) or (hi and hi > 0)):
        return df
    sz = size_number(c)
    cond = sz.isNotNull()
    if lo and lo > 0:
        cond = cond & (sz >= lo)
    if hi and hi > 0:
        cond = cond & (sz <= hi)
    return df.filter(cond)


def auction_within(df: DataFrame, days: int, as_of, c="auction_date") -> DataFrame:
    """0 <= days until auction <= days (0 = off)."""
    if not days or days <= 0:
        return df
    d = days_until(c, as_of)
    return df.filter((d >= 0) & (d <= days))


def discount_at_least(df: DataFrame, pct: int, c="discount") -> DataFrame:
    """Discount percentage >= pct (0 = off)."""
    if not pct or pct <= 0:
        return df
    return df.filter(discount_value(c) >= pct)


def auction_between(df: DataFrame, start, end, c="auction_date") -> DataFrame:
    """Auction day (dashboard parser: the date anywhere in the text) within [start, end] inclusive."""
    d = parse_date_anywhere(c)
    return df.filter(d.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def type_in(df: DataFrame, types, c="property_type") -> DataFrame:
    """Set membership; an empty set is no filter."""
    types = list(types or [])
    return df.filter(col(c).isin(types)) if types else df


def location_in(df: DataFrame, locations, c="location") -> DataFrame:
    """Set membership on the cleaned location; an empty set is no filter."""
    locations = list(locations or [])
    return df.filter(col(c).isin(locations)) if locations else df


def keyword_all_expr(text: Column, query: str | None) -> Column:
    """Every whitespace token of the lowercased query is a substring of the search text."""
    tokens = [t for t in (query or "").lower().split() if t]
    cond = F.lit(True)
    for t in tokens:
        cond = cond & text.contains(t)
    return cond


def keyword_all(df: DataFrame, query: str | None, c="search_text") -> DataFrame:
    """C10 as a filter."""
    if not (query or "").strip():
        return df
    return df.filter(keyword_all_expr(col(c), query))


def type_contains(df: DataFrame, word: str, c="property_type") -> DataFrame:
    """C11: the chat word goes through the alias map to one of the five types; then exact match (Q10)."""
    target = resolve_type_alias(word)
    return df.filter(F.lower(F.coalesce(col(c), F.lit(""))) == target.lower())


def location_contains(df: DataFrame, area: str, c="location") -> DataFrame:
    """C11: case-insensitive substring of the location."""
    return df.filter(F.lower(F.coalesce(col(c), F.lit(""))).contains(area.lower()))


def price_under(df: DataFrame, amount: float, c="price") -> DataFrame:
    """0 < price <= amount (price read by B12)."""
    p = price_value_all(c)
    return df.filter((p > 0) & (p <= amount))


def price_above(df: DataFrame, amount: float, c="price") -> DataFrame:
    """Price >= amount (price read by B12)."""
    return df.filter(price_value_all(c) >= amount)


def in_bounds(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Has coordinates and lies inside the box."""
    return df.filter(
        F.col("lat").isNotNull() & F.col("lng").isNotNull()
        & F.col("lat").between(south, north) & F.col("lng").between(west, east)
    )


# Generic titles that make an entry without id, address and size unmatchable.
GENERIC_TITLE_PATTERNS = (
    r"^\d+(\.\d+)?\s+Storey\s+",
    r"^Office\s+(Unit|Lot)$",
    r"^Shop\s+(Lot|Unit)$",
    r"^Warehouse$",
    r"^Factory$",
)
PLACEHOLDER_TITLE_PREFIX = "Property Listing"
SIZE_SENTINEL = "Size not specified"


def dedup_address(df_cols=None) -> Column:
    """Address used by the dedup: B3 of header, else header_full."""
    header = F.col("header") if df_cols is None or "header" in df_cols else F.lit(None).cast("string")
    return norm_address(F.coalesce(F.nullif(header, F.lit("")), F.nullif(F.col("header_full"), F.lit("")), F.lit("")))


def is_junk(df_cols) -> Column:
    """C14: no listing id, address of at most 20 chars, and either a placeholder title or (no size and a
    generic title)."""
    title = F.coalesce(F.col("title"), F.lit(""))
    lid = F.coalesce(F.col("listing_id"), F.lit(""))
    addr = dedup_address(df_cols)
    size = F.coalesce(F.col("size"), F.lit(""))
    has_size = (size != "") & (size != SIZE_SENTINEL)
    generic = F.lit(False)
    for p in GENERIC_TITLE_PATTERNS:
        generic = generic | title.rlike("(?i)" + p)
    return (lid == "") & ~(F.length(addr) > 20) & (title.startswith(PLACEHOLDER_TITLE_PREFIX) | (~has_size & generic))


def geocode_candidates(df: DataFrame, as_of) -> DataFrame:
    """Distinct non-expired addresses (trimmed) longer than 5 chars."""
    addr = F.trim(F.coalesce(F.col("header_full"), F.lit("")))
    return (
        df.filter(~is_expired(as_of))
        .select(addr.alias("address"))
        .filter(F.length("address") > 5)
        .distinct()
    )


def scheme_candidates(df: DataFrame, as_of, order=("scan_date", "obs_seq")) -> DataFrame:
    """Non-expired rows with address and title; one row per address with the last title in order."""
    addr = F.trim(F.coalesce(F.col("header_full"), F.lit("")))
    key = F.struct(*[F.col(c) for c in order])
    return (
        df.filter(~is_expired(as_of))
        .select(addr.alias("address"), F.col("title"), key.alias("_k"))
        .filter((F.col("address") != "") & (F.coalesce(F.col("title"), F.lit("")) != ""))
        .groupBy("address")
        .agg(F.max_by("title", "_k").alias("title"))
    )


@dataclass
class ListingSpec:
    """The dashboard's filter state. Bound 0 or empty = off."""

    query: str = ""
    types: list = field(default_factory=list)
    locations: list = field(default_factory=list)
    status: str = "active"
    min_price: int = 0
    max_price: int = 0
    min_size: float = 0
    max_size: float = 0
    days_ahead: int = 0
    min_discount: int = 0
    week: tuple | None = None
    sort: str = "price_asc"
    page: int = 1
    page_size: int = 20


def listing_condition(spec: ListingSpec, as_of) -> Column:
    """C15 as one condition: tokens, types, locations, status, price, size, days ahead, discount and week range of a spec, those that are
    on. For rows with search_text, property_type, location, is_expired, price_value, size, auction_date and discount."""
    conds = [keyword_all_expr(F.col("search_text"), spec.query)]
    if spec.types:
        conds.append(F.col("property_type").isin(list(spec.types)))
    if spec.locations:
        conds.append(F.col("location").isin(list(spec.locations)))
    if spec.status in ("active", "expired"):
        conds.append(F.col("is_expired") if spec.status == "expired" else ~F.col("is_expired"))
    pv, sz = F.coalesce(F.col("price_value"), F.lit(0)), size_number("size")
    for lo, hi, value in ((spec.min_price, spec.max_price, pv), (spec.min_size, spec.max_size, sz)):
        if lo and lo > 0:
            conds.append(value >= lo)
        if hi and hi > 0:
            conds.append(value <= hi)
    if spec.days_ahead and spec.days_ahead > 0:
        conds.append(days_until("auction_date", as_of).between(0, spec.days_ahead))
    if spec.min_discount and spec.min_discount > 0:
        conds.append(discount_value("discount") >= spec.min_discount)
    if spec.week:
        conds.append(parse_date_anywhere("auction_date").between(F.to_date(F.lit(spec.week[0])), F.to_date(F.lit(spec.week[1]))))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def apply_listing_filters(df: DataFrame, spec: ListingSpec, as_of) -> DataFrame:
    """C15 as a filter."""
    return df.filter(listing_condition(spec, as_of))
