"""Catalog: scalar expressions (B) applied to the fixture observations and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from . import context as C
from .registry import register
from .sqlviews import (
    AS_OF_DATE_SQL, sql_auction_day, sql_norm_address, sql_norm_size, sql_norm_text, sql_price_value,
    sql_stable_key, sql_strip, sql_type,
)


def _slug_sql(parts, n):
    cleaned = [f"regexp_replace(coalesce({p}, ''), '[^\\pL\\pN_\\s]', '', 'g')" for p in parts]
    joined = " || '_' || ".join(cleaned)
    base = f"lower(regexp_replace({sql_strip(joined)}, '\\s+', '_', 'g'))"
    return f"CASE WHEN {base} = '' THEN 'property' ELSE substr({base}, 1, {n}) END"


@register("b1_b6_text_keys", "B1, B2, B3, B4, B5, B6", views=("obs",), sql=f"""
SELECT DISTINCT title, location, size, header_full, price, auction_date,
       {sql_norm_text('title')} AS norm_title, {sql_norm_text('location')} AS norm_location,
       {sql_norm_size('size')} AS norm_size, {sql_norm_address('header_full')} AS norm_address,
       {sql_stable_key()} AS stable_key, {sql_stable_key(address_form='address')} AS stable_key_dedup,
       {_slug_sql(['title', 'location', 'size', 'header_full'], 150)} AS slug,
       {_slug_sql(['title', 'location', 'size'], 120)} AS slug_short,
       md5(lower(coalesce(title, '') || '_' || coalesce(price, '') || '_' || coalesce(auction_date, '') || '_'
                 || coalesce(location, '') || '_' || coalesce(size, ''))) AS obs_hash
FROM obs
""")
def b1_b6_text_keys(spark, sf_dir):
    o = C.obs(spark, sf_dir)
    return o.select(
        "title", "location", "size", "header_full", "price", "auction_date",
        X.norm_text("title").alias("norm_title"),
        X.norm_text("location").alias("norm_location"),
        X.norm_size("size").alias("norm_size"),
        X.norm_address("header_full").alias("norm_address"),
        X.stable_key("title", "location", "size", "header_full").alias("stable_key"),
        X.stable_key("title", "location", "size", "header_full", address_form="address").alias("stable_key_dedup"),
        X.property_slug("title", "location", "size", "header_full", 150).alias("slug"),
        X.property_slug("title", "location", "size", None, 120).alias("slug_short"),
        X.observation_hash("title", "price", "auction_date", "location", "size").alias("obs_hash"),
    ).distinct()


_PRICE_CLEAN = "TRY_CAST(nullif(regexp_replace(coalesce(price, ''), '[^0-9.]', '', 'g'), '') AS DOUBLE)"
_SCALED = f"(CASE WHEN {_PRICE_CLEAN} < 1000 THEN {_PRICE_CLEAN} * 1000 ELSE {_PRICE_CLEAN} END)"
_DATE_SHAPE = "'^\\d{1,2}\\s+\\w{3}\\s+\\d{4}\\s+\\(\\w{3}\\)'"
_NO_DAY = sql_strip("regexp_replace(coalesce(auction_date, ''), '\\s*\\(\\w{3}\\)', '')")
_DAYS_M = "'(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})'"
_DAYS_D = (f"CASE WHEN regexp_matches(coalesce(auction_date, ''), {_DAYS_M}) THEN TRY_CAST(try_strptime(regexp_extract(auction_date, {_DAYS_M}, 1) || ' ' || "
           f"regexp_extract(auction_date, {_DAYS_M}, 2) || ' ' || regexp_extract(auction_date, {_DAYS_M}, 3), '%d %b %Y') AS DATE) END")
_STATES = ("Kuala Lumpur", "Selangor", "Johor", "Penang", "Perak", "Kedah", "Kelantan", "Terengganu", "Pahang",
           "Negeri Sembilan", "Melaka", "Sabah", "Sarawak", "Putrajaya", "Labuan")
_STATE_SQL = "CASE " + " ".join(f"WHEN contains(lower(coalesce(header_full, '')), '{s.lower()}') THEN '{s}'" for s in _STATES) + " ELSE 'Malaysia' END"
_AMOUNT_S = "lower(regexp_replace(coalesce(price, ''), '[,\\s]', '', 'g'))"
_AMOUNT_M = "'^(?:rm)?([0-9]+(?:\\.[0-9]+)?)([km]?)$'"


@register("b7_b30_parse", "B7, B8, B10, B11, B13, B15, B16, B17, B22, B23, B25, B28, B30", views=("obs",), sql=f"""
SELECT DISTINCT price, auction_date, discount, size, header_full, last_updated, price_value,
       coalesce({_PRICE_CLEAN} IS NOT NULL AND {_SCALED} BETWEEN 50000 AND 500000000, false) AS price_valid,
       CASE WHEN {_PRICE_CLEAN} IS NULL THEN 0 ELSE CAST(trunc({_SCALED}) AS BIGINT) END AS price_checked,
       regexp_matches(coalesce(auction_date, ''), {_DATE_SHAPE}) AS date_shape_ok,
       regexp_matches(coalesce(auction_date, ''), {_DATE_SHAPE})
         AND coalesce(TRY_CAST(try_strptime({_NO_DAY}, '%d %b %Y') AS DATE) >= {AS_OF_DATE_SQL}, false) AS date_upcoming,
       {sql_auction_day('auction_date')} AS auction_day,
       {sql_price_value('price')} AS price_num,
       {sql_price_value('price')} >= 10000 AS price_is_valid,
       {sql_price_value('size')} AS size_sort,
       TRY_CAST(nullif(regexp_extract(replace(coalesce(size, ''), ',', ''), '([0-9.]+)', 1), '') AS DOUBLE) AS size_num,
       coalesce(TRY_CAST(nullif(regexp_extract(coalesce(discount, ''), '-(\\d+)', 1), '') AS INTEGER), 0) AS discount_pct,
       coalesce(date_diff('day', {AS_OF_DATE_SQL}, {_DAYS_D}), 999) AS days_until,
       nullif(regexp_extract(coalesce(header_full, ''), '\\b(\\d{{5}})\\b', 1), '') AS postcode,
       {_STATE_SQL} AS state,
       CASE WHEN regexp_matches({_AMOUNT_S}, {_AMOUNT_M})
            THEN TRY_CAST(regexp_extract({_AMOUNT_S}, {_AMOUNT_M}, 1) AS DOUBLE)
                 * CASE regexp_extract({_AMOUNT_S}, {_AMOUNT_M}, 2) WHEN 'k' THEN 1000.0 WHEN 'm' THEN 1000000.0 ELSE 1.0 END END AS amount,
       substr(coalesce(last_updated, ''), 1, 10) AS day_only,
       {sql_strip("regexp_replace(coalesce(auction_date, ''), '\\s*\\(.*$', '', 's')")} AS auction_text,
       substr(coalesce(header_full, ''), 1, 120) AS short_address,
       'RM' || format('{{:,}}', price_value) AS price_text
FROM obs
""")
def b7_b30_parse(spark, sf_dir):
    o = C.obs(spark, sf_dir).select("price", "auction_date", "discount", "size", "header_full", "last_updated", "price_value").distinct()
    vp = X.validate_price("price")
    return o.select(  # what equal texts give is equal: each is parsed once
        "price", "auction_date", "discount", "size", "header_full", "last_updated", "price_value",
        vp["valid"].alias("price_valid"), vp["value"].alias("price_checked"),
        X.validate_auction_date("auction_date").alias("date_shape_ok"),
        X.validate_auction_date("auction_date", C.AS_OF, include_expired=False).alias("date_upcoming"),
        X.parse_auction_date("auction_date").alias("auction_day"),
        X.price_value("price").alias("price_num"),
        X.is_valid_price("price").alias("price_is_valid"),
        X.size_value("size").alias("size_sort"),
        X.size_number("size").alias("size_num"),
        X.discount_value("discount").alias("discount_pct"),
        X.days_until("auction_date", C.AS_OF).cast("bigint").alias("days_until"),
        X.extract_postcode("header_full").alias("postcode"),
        X.extract_state("header_full").alias("state"),
        X.parse_amount("price").alias("amount"),
        X.date_only("last_updated").alias("day_only"),
        X.strip_weekday("auction_date").alias("auction_text"),
        X.short_address("header_full").alias("short_address"),
        X.format_amount("price_value").alias("price_text"),
    )


@register("b9_property_type", "B9", views=("obs",), sql=f"""
SELECT title, {sql_type('title')} AS property_type, count(*) AS n FROM obs GROUP BY 1, 2
""")
def b9_property_type(spark, sf_dir):
    o = C.obs(spark, sf_dir)
    n = o.groupBy("title").agg(F.count(F.lit(1)).alias("n"))  # a title has one type: told once for each title
    return n.select("title", X.categorize_property_type("title").alias("property_type"), "n")


_LOC_X1 = sql_strip("regexp_extract(coalesce(location, ''), '^([^\\[\\]]*)', 1)")
_LOC_X2 = f"regexp_replace({_LOC_X1}, '[;,\\s]+$', '')"
_LOC_X3 = sql_strip(f"regexp_replace({_LOC_X2}, '\\s+with\\s+.*$', '', 'is')")
_LOC_X4 = ("replace(" + sql_strip(f"regexp_replace(regexp_replace({_LOC_X3}, '&(\\s+Selangor)', chr(1) || '\\1', 'g'), '\\s*&\\s+.*$', '', 's')")
           + ", chr(1), '&')")
_LOC_X5 = sql_strip(f"regexp_replace({_LOC_X4}, ';.*$', '', 's')")
SQL_CLEAN_LOCATION = f"(CASE WHEN coalesce(location, '') = '' OR length({_LOC_X5}) < 3 THEN 'KL/Selangor' ELSE {_LOC_X5} END)"

_SCHEME_HDR = f"(CASE WHEN contains(coalesce(header_short, ''), ',') THEN {sql_strip(chr(114) + 'egexp_extract(header_short, ' + chr(39) + '^(.*),' + chr(39) + ', 1)')} ELSE '' END)"
_NAMED = ("'(?:,\\s*)?([A-Z][A-Za-z\\s]+(?:Park|Centre|Point|Plaza|Place|Heights|Residences?|Tower|City|Garden|Court|Square|"
          "Perdagangan|Komersial|Damansara|Business|Mall|Complex|Kompleks)[A-Za-z\\s]*)'")
_A = "coalesce(header_full, '')"
_PARTS = f"list_transform(string_split({_A}, ','), lambda s: {sql_strip('s')})"
_GOOD = (f"list_filter(list_slice({_PARTS}, 1, 3), lambda s: s <> '' AND NOT regexp_matches(s, '^\\d') "
         f"AND NOT regexp_matches(s, '(?i)^((Lot|Block|Unit|Level|Ground|First|Second)\\b|No\\.)') AND length(s) > 5)")
_FIRST_GOOD = f"{_GOOD}[1]"
SQL_SCHEME_ADDR = (f"(CASE WHEN {_A} = '' OR {_A} = coalesce(title, '') THEN '' ELSE coalesce("
                   f"nullif({sql_strip(f'regexp_extract({_A}, {_NAMED}, 1)')}, ''), "
                   f"nullif({sql_strip(f'regexp_extract({_A}, {chr(39)}\\(([^)]+)\\){chr(39)}, 1)')}, ''), "
                   f"CASE WHEN length({_FIRST_GOOD}) > 50 THEN substr({_FIRST_GOOD}, 1, 47) || '...' ELSE {_FIRST_GOOD} END, "
                   f"{_PARTS}[1], '') END)")


@register("b14_b24_location_scheme", "B14, B19, B20, B21, B24", views=("obs",), sql=f"""
SELECT DISTINCT location, header_short, header_full, title, size, price,
       {SQL_CLEAN_LOCATION} AS location_clean,
       {_SCHEME_HDR} AS scheme_header,
       {SQL_SCHEME_ADDR} AS scheme_address,
       coalesce(nullif({_SCHEME_HDR}, ''), nullif({SQL_SCHEME_ADDR}, ''), '') AS scheme,
       lower(coalesce(title, '') || ' ' || coalesce(location, '') || ' ' || {sql_type('title')} || ' ' || coalesce(size, '')
             || ' ' || coalesce(nullif({_SCHEME_HDR}, ''), nullif({SQL_SCHEME_ADDR}, ''), '')) AS chat_text
FROM obs
""")
def b14_b24_location_scheme(spark, sf_dir):
    o = C.obs(spark, sf_dir)
    scheme = X.resolve_scheme(F.lit(None).cast("string"), F.lit(None).cast("string"), "header_short", "header_full", "title")
    return o.select(
        "location", "header_short", "header_full", "title", "size", "price",
        X.clean_location("location").alias("location_clean"),
        X.scheme_from_header("header_short").alias("scheme_header"),
        X.scheme_from_address("header_full", "title").alias("scheme_address"),
        scheme.alias("scheme"),
        X.chat_search_text("title", "location", X.categorize_property_type("title"), "size", scheme).alias("chat_text"),
    ).distinct()
