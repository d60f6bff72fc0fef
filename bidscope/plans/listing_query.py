"""The parameterised listing query (C15 with G1-G3) and the chat queries (C10-C12 with G9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat_search_text, parse_amount, price_value_all, resolve_type_alias
from ..operators import predicates as P
from ..operators import rank as R
from ..operators.predicates import ListingSpec

# Query specs exercised by the catalog (page 2 of each, so paging is checked too).
LISTING_SPECS = {
    "s1_default": ListingSpec(page=2),
    "s2_price_desc_landed": ListingSpec(types=["Landed"], sort="price_desc", page=2, status="all"),
    "s3_keyword_discount": ListingSpec(query="shah alam", min_discount=30, sort="discount", page=2),
    "s4_size_range": ListingSpec(min_size=1000, max_size=3000, sort="size_desc", page=2, status="all"),
    "s5_soon_price": ListingSpec(days_ahead=60, min_price=50_000, max_price=600_000, sort="date_asc", page=2),
    "s6_expired_location": ListingSpec(status="expired", locations=["Kuala Lumpur"], sort="size_asc", page=2),
    "s7_week": ListingSpec(week=("2001-10-08", "2001-10-14"), sort="unknown", page=1),
}


def listing_query(published: DataFrame, spec: ListingSpec, as_of, dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """(page rows with rank, filtered rows). Source rows are the F3-deduplicated listings; filters are
    applied in the dashboard's order, then the G1 sort and the G3 page. The caller counts the filtered rows
    for the total (one aggregate, no row goes to the driver)."""
    src = R.dedup_listings(published) if dedup else published
    filtered = P.apply_listing_filters(src, spec, as_of)
    order = R.listing_sort_order(spec.sort, as_of)
    return R.page(filtered, order, spec.page, spec.page_size), filtered


def listing_queries(published: DataFrame, specs: dict[str, ListingSpec], as_of, keep: list[str], dedup: bool = True, after: dict[str, tuple[float, int]] | None = None) -> DataFrame:
    """C15 for many specs in one pass: ``(spec, rank, total, sort_key, arrival, *keep)`` of each spec's page. With ``after`` (spec -> sort key
    and arrival of the last row seen) a spec's page is the one that follows (G3 by position in the order instead of by number)."""
    src = R.dedup_listings(published) if dedup else published
    wanted = {name: (P.listing_condition(spec, as_of), R.listing_sort_key(spec.sort, as_of)) for name, spec in specs.items()}
    start = {name: 0 if after and name in after else (spec.page - 1) * spec.page_size for name, spec in specs.items()}
    ends = {name: start[name] + spec.page_size for name, spec in specs.items()}
    rows = R.rank_by_spec(src, wanted, "arrival", max(ends.values()), keep, after)
    on_page = F.lit(False)
    for name in specs:
        on_page = on_page | ((F.col("spec") == name) & F.col("rank").between(start[name] + 1, ends[name]))
    return rows.where(on_page)


def table_query(published: DataFrame, query: str, status: str, col: str, direction: str, as_of,
                page_no: int = 1) -> tuple[DataFrame, DataFrame]:
    """C15, table variant: tokens and status only, G2 sort, 50 rows a page."""
    src = R.dedup_listings(published)
    filtered = P.status(P.keyword_all(src, query), status)
    return R.page(filtered, R.table_sort_order(col, direction, as_of), page_no, 50), filtered


# Chat queries: (kind, argument). All sort by price (B12) ascending and show the first 15 with the total.
CHAT_SPECS = {
    "search_shah_alam_terrace": ("search", "shah alam terrace"),
    "type_factory": ("type", "factory"),
    "under_300k": ("under", "300k"),
    "above_1m": ("above", "1m"),
    "location_kuala": ("location", "kuala"),
}


def chat_condition(kind: str, arg: str) -> Column:
    """The condition of a chat query on the state (with ``chat_text``)."""
    if kind == "search":
        return P.keyword_all_expr(F.col("chat_text"), arg)
    if kind == "type":
        return F.lower(F.coalesce("property_type", F.lit(""))) == resolve_type_alias(arg).lower()
    if kind == "location":
        return F.lower(F.coalesce("location", F.lit(""))).contains(arg.lower())
    amount, price = parse_amount(F.lit(arg)), F.col("_price_num")
    return (price > 0) & (price <= amount) if kind == "under" else price >= amount


def chat_queries(state: DataFrame, specs: dict[str, tuple[str, str]], keep: list[str], k: int = 15) -> DataFrame:
    """G9 for many chat queries in one pass: ``(spec, rank, total, sort_key, first_obs_seq, *keep)`` of the first ``k`` rows by price."""
    s = state if "scheme_name" in state.columns else state.withColumn("scheme_name", F.lit(None).cast("string"))
    s = s.withColumn("_price_num", price_value_all("price")).withColumn("chat_text", chat_search_text("title", "location", "property_type", "size", "scheme_name"))
    wanted = {name: (F.coalesce(chat_condition(kind, arg), F.lit(False)), F.col("_price_num").cast("double")) for name, (kind, arg) in specs.items()}
    return R.rank_by_spec(s, wanted, "first_obs_seq", k, keep)
