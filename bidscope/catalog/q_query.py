"""Catalog: publish (A6), dedup (F3), predicates (C), listing query (C15), sorting / paging / top-k (G),
type shares and facets (E2, E4), active/expired split (H4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import market, predicates as P, rank as R
from ..operators.history import price_drop_pct, price_points, recent_prices
from ..plans.listing_query import CHAT_SPECS, LISTING_SPECS, chat_queries, listing_queries
from . import context as C
from .registry import register
from .sqlviews import AS_OF_DATE_SQL, register_published

register_published()

PUB_COLS = ("p_partkey", "title", "price", "price_value", "location", "size", "auction_text", "auction_date",
            "property_type", "discount", "listing_url", "image_url", "address", "lat", "lng", "scheme_name",
            "is_expired", "is_active", "search_text")


@register("a6_publish_listings", "A6, C2, D6, D7, F9, F8, F10, B14, B21, B24, B28", views=("published",), sql=f"""
SELECT {', '.join(PUB_COLS)}, n_ph, n_hist FROM published
""")
def a6_publish_listings(spark, sf_dir):
    p = C.publish(spark, sf_dir)
    return p.select(*PUB_COLS, F.size("ph").cast("bigint").alias("n_ph"), F.size("hist").cast("bigint").alias("n_hist"))


@register("f3_dedup_listings", "F3", views=("dedup_pub",), sql="""
SELECT p_partkey, title, price_value, auction_text, address, is_expired FROM dedup_pub
""")
def f3_dedup_listings(spark, sf_dir):
    d = R.dedup_listings(C.published(spark, sf_dir))
    return d.select("p_partkey", "title", "price_value", "auction_text", "address", "is_expired")


def _tag(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("predicate"), "p_partkey")


_SIZE_NUM = "TRY_CAST(nullif(regexp_extract(replace(size, ',', ''), '([0-9.]+)', 1), '') AS DOUBLE)"
_SIZE_INT = "coalesce(TRY_CAST(nullif(replace(regexp_extract(size, '[0-9,]+', 0), ',', ''), '') AS BIGINT), 0)"
_DAYS = (f"coalesce(date_diff('day', {AS_OF_DATE_SQL}, CASE WHEN regexp_matches(auction_text, '(\\d{{1,2}})\\s+(\\w{{3}})\\s+(\\d{{4}})') "
         f"THEN TRY_CAST(try_strptime(regexp_extract(auction_text, '(\\d{{1,2}})\\s+(\\w{{3}})\\s+(\\d{{4}})', 1) || ' ' || "
         f"regexp_extract(auction_text, '(\\d{{1,2}})\\s+(\\w{{3}})\\s+(\\d{{4}})', 2) || ' ' || "
         f"regexp_extract(auction_text, '(\\d{{1,2}})\\s+(\\w{{3}})\\s+(\\d{{4}})', 3), '%d %b %Y') AS DATE) END), 999)")
_DISC = "coalesce(TRY_CAST(nullif(regexp_extract(discount, '-(\\d+)', 1), '') AS INTEGER), 0)"
_B12 = "coalesce(TRY_CAST(nullif(regexp_replace(price, '[^0-9.]', '', 'g'), '') AS DOUBLE), 0.0)"
_DAY = ("TRY_CAST(try_strptime(regexp_extract(auction_text, '(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})', 1) || ' ' || "
        "regexp_extract(auction_text, '(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})', 2) || ' ' || "
        "regexp_extract(auction_text, '(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})', 3), '%d %b %Y') AS DATE)")


@register("c1_c13_predicates", "C1, C2, C3, C4, C5, C6, C7, C8, C9, C10, C11, C12", views=("published",), sql=f"""
SELECT 'c1_active' AS predicate, p_partkey FROM published WHERE is_active
UNION ALL SELECT 'c2_expired', p_partkey FROM published WHERE is_expired
UNION ALL SELECT 'c3_status_active', p_partkey FROM published WHERE NOT is_expired
UNION ALL SELECT 'c4_price_between', p_partkey FROM published WHERE price_value >= 100000 AND price_value <= 500000
UNION ALL SELECT 'c5_size_between', p_partkey FROM published WHERE {_SIZE_NUM} IS NOT NULL AND {_SIZE_NUM} >= 1000 AND {_SIZE_NUM} <= 2000
UNION ALL SELECT 'c6_auction_within', p_partkey FROM published WHERE {_DAYS} >= 0 AND {_DAYS} <= 30
UNION ALL SELECT 'c7_discount_at_least', p_partkey FROM published WHERE {_DISC} >= 30
UNION ALL SELECT 'c8_auction_between', p_partkey FROM published WHERE {_DAY} BETWEEN DATE '2001-10-15' AND DATE '2001-11-15'
UNION ALL SELECT 'c9_type_in', p_partkey FROM published WHERE property_type IN ('Landed', 'Land')
UNION ALL SELECT 'c9_location_in', p_partkey FROM published WHERE location IN ('Kuala Lumpur', 'Selangor')
UNION ALL SELECT 'c10_keyword_all', p_partkey FROM published WHERE contains(search_text, 'shah') AND contains(search_text, 'alam') AND contains(search_text, 'terrace')
UNION ALL SELECT 'c11_type_contains', p_partkey FROM published WHERE lower(property_type) = 'landed'
UNION ALL SELECT 'c11_location_contains', p_partkey FROM published WHERE contains(lower(location), 'kuala')
UNION ALL SELECT 'c12_price_under', p_partkey FROM published WHERE {_B12} > 0 AND {_B12} <= 200000
UNION ALL SELECT 'c12_price_above', p_partkey FROM published WHERE {_B12} >= 800000
""")
def c1_c13_predicates(spark, sf_dir):
    p = C.published(spark, sf_dir)
    a = C.AS_OF
    parts = [
        _tag(P.active(p, a), "c1_active"),
        _tag(p.filter(F.col("is_expired")), "c2_expired"),
        _tag(P.status(p, "active"), "c3_status_active"),
        _tag(P.price_between(p, 100_000, 500_000), "c4_price_between"),
        _tag(P.size_between(p, 1000, 2000), "c5_size_between"),
        _tag(P.auction_within(p, 30, a), "c6_auction_within"),
        _tag(P.discount_at_least(p, 30), "c7_discount_at_least"),
        _tag(P.auction_between(p, "2001-10-15", "2001-11-15", c="auction_text"), "c8_auction_between"),
        _tag(P.type_in(p, ["Landed", "Land"]), "c9_type_in"),
        _tag(P.location_in(p, ["Kuala Lumpur", "Selangor"], c="location"), "c9_location_in"),
        _tag(P.keyword_all(p, "Shah Alam  terrace"), "c10_keyword_all"),
        _tag(P.type_contains(p, "bungalow"), "c11_type_contains"),
        _tag(P.location_contains(p, "Kuala"), "c11_location_contains"),
        _tag(P.price_under(p, 200_000), "c12_price_under"),
        _tag(P.price_above(p, 800_000), "c12_price_above"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _spec_sql(name, spec) -> str:
    conds = ["true"]
    for tok in (spec.query or "").lower().split():
        conds.append(f"contains(search_text, '{tok}')")
    if spec.types:
        conds.append("property_type IN (" + ", ".join(f"'{t}'" for t in spec.types) + ")")
    if spec.locations:
        conds.append("location IN (" + ", ".join(f"'{t}'" for t in spec.locations) + ")")
    if spec.status == "active":
        conds.append("NOT is_expired")
    elif spec.status == "expired":
        conds.append("is_expired")
    if spec.min_price:
        conds.append(f"price_value >= {spec.min_price}")
    if spec.max_price:
        conds.append(f"price_value <= {spec.max_price}")
    if spec.min_size or spec.max_size:
        conds.append(f"{_SIZE_NUM} IS NOT NULL")
        if spec.min_size:
            conds.append(f"{_SIZE_NUM} >= {spec.min_size}")
        if spec.max_size:
            conds.append(f"{_SIZE_NUM} <= {spec.max_size}")
    if spec.days_ahead:
        conds.append(f"{_DAYS} >= 0 AND {_DAYS} <= {spec.days_ahead}")
    if spec.min_discount:
        conds.append(f"{_DISC} >= {spec.min_discount}")
    if spec.week:
        conds.append(f"{_DAY} BETWEEN DATE '{spec.week[0]}' AND DATE '{spec.week[1]}'")
    sorts = {
        "price_asc": "price_value", "price_desc": "price_value DESC", "date_asc": _DAYS,
        "discount": f"{_DISC} DESC", "size_desc": f"{_SIZE_INT} DESC", "size_asc": _SIZE_INT,
    }
    order = sorts.get(spec.sort, sorts["price_asc"]) + ", arrival"
    lo = (spec.page - 1) * spec.page_size
    return f"""
SELECT '{name}' AS spec, rank, p_partkey, total FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY {order}) AS rank, count(*) OVER () AS total
  FROM dedup_pub WHERE {' AND '.join(conds)}) t
WHERE rank > {lo} AND rank <= {lo + spec.page_size}"""


@register("c15_listing_query", "C15, G1, G3, C3-C10", views=("dedup_pub",),
          sql="\nUNION ALL\n".join(_spec_sql(n, s) for n, s in LISTING_SPECS.items()))
def c15_listing_query(spark, sf_dir):
    return listing_queries(C.published(spark, sf_dir), LISTING_SPECS, C.AS_OF, ["p_partkey"]).select("spec", "rank", "p_partkey", "total")


@register("g2_table_sort", "G2, G3", views=("dedup_pub",), sql=f"""
SELECT rank, p_partkey FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY {_SIZE_NUM.replace("TRY_CAST(nullif(regexp_extract(replace(size, ',', ''), '([0-9.]+)', 1), '') AS DOUBLE)", "coalesce(TRY_CAST(nullif(replace(regexp_extract(size, '[0-9,]+', 0), ',', ''), '') AS BIGINT), 0)")} DESC, arrival) AS rank
  FROM dedup_pub WHERE NOT is_expired AND contains(search_text, 'selangor')) t
WHERE rank > 50 AND rank <= 100
""")
def g2_table_sort(spark, sf_dir):
    from ..plans.listing_query import table_query
    rows, _ = table_query(C.published(spark, sf_dir), "Selangor", "active", "size", "desc", C.AS_OF, page_no=2)
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "p_partkey")


def _active_dedup(spark, sf_dir):
    return R.dedup_listings(C.published(spark, sf_dir).filter(~F.col("is_expired")))


_ACT = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY title, price_value, auction_text, address ORDER BY CASE WHEN size <> '' AND size <> 'Size not specified' THEN 0 ELSE 1 END, arrival) AS rn FROM published WHERE NOT is_expired) a WHERE rn = 1)"


def _notable_sql(name, where, order, k=8) -> str:
    return f"""
SELECT '{name}' AS list, rank, p_partkey FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY {order}, arrival) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY title, price_value, auction_text ORDER BY {order}, arrival) AS kn
    FROM act WHERE {where}) b WHERE kn = 1) c
WHERE rank <= {k}"""


_DROPS = "(SELECT p_partkey AS dk, CASE WHEN count(*) >= 2 AND arg_min(pv, pos) > 0 AND arg_max(pv, pos) > 0 AND arg_max(pv, pos) < arg_min(pv, pos) THEN (arg_min(pv, pos) - arg_max(pv, pos)) * 100.0 / arg_min(pv, pos) ELSE 0.0 END AS drop_pct FROM (SELECT p_partkey, pos, coalesce(TRY_CAST(nullif(replace(regexp_extract(price, '[0-9,]+', 0), ',', ''), '') AS BIGINT), 0) AS pv FROM recent5) t GROUP BY 1)"


@register("g4_g8_top_lists", "G4, G5, G6, G7, G8, F11", views=("published", "recent5"), sql=f"""
WITH act AS {_ACT}, actd AS (SELECT * FROM act JOIN {_DROPS} d ON d.dk = act.p_partkey)
SELECT 'hot_deals' AS list, rank, p_partkey FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY {_DISC} DESC, arrival) AS rank FROM act WHERE discount <> '') h WHERE rank <= 5
UNION ALL {_notable_sql('drops', 'true', 'drop_pct DESC').replace('FROM act WHERE true', 'FROM actd WHERE drop_pct > 0')}
UNION ALL {_notable_sql('soon', f'{_DAYS} >= 0 AND {_DAYS} <= 7', _DAYS)}
UNION ALL {_notable_sql('affordable', 'price_value > 0 AND price_value < 300000', 'price_value')}
UNION ALL {_notable_sql('landed', "property_type = 'Landed'", 'price_value')}
""")
def g4_g8_top_lists(spark, sf_dir):
    act = _active_dedup(spark, sf_dir)
    drops = price_drop_pct(recent_prices(price_points(C.obsn(spark, sf_dir), C.ENTITY), C.ENTITY), C.ENTITY)
    lists = {
        "hot_deals": R.hot_deals(act),
        "drops": R.notable_drops(act, drops, C.ENTITY),
        "soon": R.notable_soon(act, C.AS_OF),
        "affordable": R.notable_affordable(act),
        "landed": R.notable_landed(act),
    }
    return reduce(DataFrame.unionByName, [
        d.select(F.lit(n).alias("list"), F.col("rank").cast("bigint").alias("rank"), "p_partkey") for n, d in lists.items()
    ])


def _chat_sql(name, kind, arg) -> str:
    b12 = "coalesce(TRY_CAST(nullif(regexp_replace(coalesce(price, ''), '[^0-9.]', '', 'g'), '') AS DOUBLE), 0.0)"
    if kind == "search":
        txt = ("lower(coalesce(title, '') || ' ' || coalesce(location, '') || ' ' || coalesce(property_type, '') || ' ' "
               "|| coalesce(size, '') || ' ' || '')")
        where = " AND ".join(f"contains({txt}, '{t}')" for t in arg.lower().split())
    elif kind == "type":
        where = "lower(coalesce(property_type, '')) = 'industrial'"
    elif kind == "location":
        where = f"contains(lower(coalesce(location, '')), '{arg}')"
    elif kind == "under":
        where = f"{b12} > 0 AND {b12} <= 300000"
    else:
        where = f"{b12} >= 1000000"
    return f"""
SELECT '{name}' AS spec, rank, p_partkey, total FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY {b12}, first_obs_seq) AS rank, count(*) OVER () AS total
  FROM statet WHERE {where}) t WHERE rank <= 15"""


@register("g9_chat_top_matches", "G9, C10, C11, C12, B24, B25", views=("statet",),
          sql="\nUNION ALL\n".join(_chat_sql(n, k, a) for n, (k, a) in CHAT_SPECS.items()))
def g9_chat_top_matches(spark, sf_dir):
    return chat_queries(C.state(spark, sf_dir), CHAT_SPECS, ["p_partkey"]).select("spec", "rank", "p_partkey", "total")


@register("e2_type_share", "E2, F3", views=("published",), sql=f"""
WITH act AS {_ACT}
SELECT coalesce(nullif(property_type, ''), 'Other') AS property_type, count(*) AS listing_count,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share_pct
FROM act GROUP BY 1
""")
def e2_type_share(spark, sf_dir):
    return market.type_share(_active_dedup(spark, sf_dir))


@register("e4_facet_values", "E4", views=("published",), sql="""
SELECT list_sort(list_distinct(list(property_type) FILTER (WHERE property_type <> ''))) AS types,
       list_sort(list_distinct(list(location) FILTER (WHERE location <> ''))) AS locations
FROM published
""")
def e4_facet_values(spark, sf_dir):
    return market.facet_values(C.published(spark, sf_dir))


@register("h4_active_expired_split", "H4, C2", views=("published",), sql="""
SELECT is_expired, is_active, count(*) AS n FROM published GROUP BY 1, 2
""")
def h4_active_expired_split(spark, sf_dir):
    return C.published(spark, sf_dir).groupBy("is_expired", "is_active").agg(F.count(F.lit(1)).alias("n"))


@register("c16_candidates", "C16, H2", views=("statet",), sql=f"""
SELECT 'geocode' AS kind, address, CAST(NULL AS VARCHAR) AS title FROM (
  SELECT DISTINCT trim(coalesce(header_full, '')) AS address FROM statet WHERE NOT {__import__('bidscope.catalog.sqlviews', fromlist=['x']).sql_is_expired()}) g
WHERE length(address) > 5
UNION ALL
SELECT 'scheme', address, arg_max(title, first_obs_seq) FROM (
  SELECT trim(coalesce(header_full, '')) AS address, title, first_obs_seq FROM statet
  WHERE NOT {__import__('bidscope.catalog.sqlviews', fromlist=['x']).sql_is_expired()}) s
WHERE address <> '' AND coalesce(title, '') <> '' GROUP BY address
""")
def c16_candidates(spark, sf_dir):
    st = C.state(spark, sf_dir)
    g = P.geocode_candidates(st, C.AS_OF).select(F.lit("geocode").alias("kind"), "address", F.lit(None).cast("string").alias("title"))
    s = P.scheme_candidates(st, C.AS_OF, order=("first_obs_seq",)).select(F.lit("scheme").alias("kind"), "address", "title")
    return g.unionByName(s)


@register("b17_b18_days_labels", "B17, B18", views=("published",), sql=f"""
SELECT p_partkey, {_DAYS} AS days,
       CASE WHEN is_expired THEN 'Expired' WHEN {_DAYS} <= 0 THEN 'Today' WHEN {_DAYS} = 1 THEN 'Tomorrow'
            ELSE 'in ' || CAST({_DAYS} AS VARCHAR) || 'd' END AS label,
       {_DAYS} <= 7 AS urgent
FROM published""")
def b17_b18_days_labels(spark, sf_dir):
    from ..functions import days_label, days_until, is_urgent

    p = C.published(spark, sf_dir).withColumn("days", days_until("auction_text", C.AS_OF).cast("bigint"))
    return p.select("p_partkey", "days", days_label("days", "is_expired").alias("label"), is_urgent("days").alias("urgent"))
