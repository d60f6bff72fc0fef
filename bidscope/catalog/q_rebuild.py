"""Catalog: scan log, stats, KPI row, digest, weekly buckets and scheme neighbours (A4, A5, A7, E3, E5, E6,
E10, D10, D11, D13, D16, G10, B29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse_date_anywhere
from ..operators import rank as R
from ..operators.history import price_drop_pct, price_points, recent_prices
from ..plans import rebuild as RB
from . import context as C
from .registry import register
from .sqlviews import EVENT_DATE, register_published

register_published()
E = C.ENTITY

# Change rows of every scan in SQL (F2), reused below.
_CHANGES = f"""changes AS (
  SELECT p_partkey, scan_date, obs_seq, change_date, type, old_value, new_value FROM (
    SELECT p_partkey, scan_date, obs_seq, change_date, 'price_change' AS type, prev_price AS old_value, price AS new_value
    FROM t WHERE prev_price IS NOT NULL AND prev_price <> price
    UNION ALL
    SELECT p_partkey, scan_date, obs_seq, change_date, 'auction_date_change', prev_ad, ad
    FROM t WHERE prev_ad IS NOT NULL AND prev_ad <> ad) u),
t AS (
  SELECT p_partkey, scan_date, obs_seq, {EVENT_DATE} AS change_date, coalesce(price, '') AS price, coalesce(auction_date, '') AS ad,
         lag(coalesce(price, '')) OVER w AS prev_price, lag(coalesce(auction_date, '')) OVER w AS prev_ad
  FROM obsn WINDOW w AS (PARTITION BY p_partkey ORDER BY scan_date, obs_seq))"""
_LOG = f"""scanlog AS (
  SELECT s.scan_date, coalesce(n.k, 0) AS new_listings_count, coalesce(c.k, 0) AS changed_properties_count,
         coalesce(c.m, 0) AS change_count, s.k AS listings_seen
  FROM (SELECT scan_date, count(*) AS k FROM obsn GROUP BY 1) s
  LEFT JOIN (SELECT fs AS scan_date, count(*) AS k FROM (SELECT p_partkey, min(scan_date) AS fs FROM obsn GROUP BY 1) x GROUP BY 1) n
    ON n.scan_date = s.scan_date
  LEFT JOIN (SELECT scan_date, count(DISTINCT p_partkey) AS k, count(*) AS m FROM changes GROUP BY 1) c ON c.scan_date = s.scan_date)"""


def _with(*parts: str) -> str:
    # t must come before changes; order the CTEs explicitly
    t_part = _CHANGES[_CHANGES.index("t AS ("):]
    ch_part = _CHANGES[: _CHANGES.index(",\nt AS (")]
    ctes = [t_part, ch_part] + list(parts)
    return "WITH " + ",\n".join(ctes) + "\n"


@register("a4_scan_log", "A4, D5, F2", views=("obsn",), sql=_with(_LOG) + "SELECT * FROM scanlog")
def a4_scan_log(spark, sf_dir):
    from ..sources.snapshots import read_scan_log, scratch_path, write_scan_log

    log = RB.scan_log(C.obsn(spark, sf_dir), E)
    path = scratch_path(spark, "scan-log")
    write_scan_log(log, path)
    write_scan_log(log.orderBy(F.desc("scan_date")).limit(1), path)  # the last scan logged again: replaced, not doubled
    return read_scan_log(spark, path).select("scan_date", "new_listings_count", "changed_properties_count",
                                             "change_count", "listings_seen")


@register("a4_scan_log_records", "A4, A7, D5, F2", views=("obsn", "state"), sql=_with() + """
SELECT r.scan_date, r.kind, r.p_partkey, r.type, r.field, r.old_value, r.new_value, r.change_date, s.title FROM (
  SELECT fs AS scan_date, 'new' AS kind, p_partkey, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS field,
         CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value, CAST(NULL AS VARCHAR) AS change_date
  FROM (SELECT p_partkey, min(scan_date) AS fs FROM obsn GROUP BY 1) x
  UNION ALL
  SELECT scan_date, 'change', p_partkey, type, CASE WHEN type = 'price_change' THEN 'Auction Price' ELSE 'Auction Date' END,
         old_value, new_value, CAST(change_date AS VARCHAR) FROM changes) r
LEFT JOIN state s ON s.p_partkey = r.p_partkey""")
def a4_scan_log_records(spark, sf_dir):
    from ..sources.snapshots import read_scan_log, scratch_path, write_scan_log

    path = scratch_path(spark, "scan-records")
    write_scan_log(RB.scan_records(C.obsn(spark, sf_dir), C.state(spark, sf_dir), E), path)
    return read_scan_log(spark, path).select("scan_date", "kind", E, "type", "field", "old_value", "new_value", "change_date", "title")


@register("e10_change_summary", "E10", views=("obsn",), sql=_with() + "SELECT scan_date, type, count(*) AS n FROM changes GROUP BY 1, 2")
def e10_change_summary(spark, sf_dir):
    return RB.change_summary(C.obsn(spark, sf_dir), E)


@register("e5_scan_history", "E5", views=("obsn",), sql=_with(_LOG) + """
SELECT row_number() OVER (ORDER BY scan_date DESC) AS rank, scan_date AS d, new_listings_count AS n,
       changed_properties_count AS c FROM scanlog ORDER BY scan_date DESC LIMIT 15""")
def e5_scan_history(spark, sf_dir):
    return RB.scan_history(RB.scan_log(C.obsn(spark, sf_dir), E))


@register("a5_scan_stats", "A5", views=("obsn",), sql=_with(_LOG) + """
SELECT scan_date AS date, listings_seen AS total_listings,
       (SELECT count(DISTINCT p_partkey) FROM obsn) AS total_tracked,
       new_listings_count AS new_listings, changed_properties_count AS changed_properties
FROM scanlog WHERE scan_date = (SELECT max(scan_date) FROM obsn)""")
def a5_scan_stats(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    return RB.scan_stats(o, E, RB.latest_scan_date(o))


@register("a7_latest_changes", "A7", views=("obsn",), sql=_with() + """
SELECT 'new' AS kind, p_partkey, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS old_value,
       CAST(NULL AS VARCHAR) AS new_value, CAST(NULL AS VARCHAR) AS change_date
FROM (SELECT p_partkey, min(scan_date) AS fs FROM obsn GROUP BY 1) x WHERE fs = (SELECT max(scan_date) FROM obsn)
UNION ALL
SELECT 'change', p_partkey, type, old_value, new_value, change_date FROM changes WHERE scan_date = (SELECT max(scan_date) FROM obsn)""")
def a7_latest_changes(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    return RB.latest_changes(o, E, RB.latest_scan_date(o))


_DROPS_SQL = ("(SELECT p_partkey, CASE WHEN count(*) >= 2 AND arg_min(pv, pos) > 0 AND arg_max(pv, pos) > 0 AND arg_max(pv, pos) < arg_min(pv, pos) "
              "THEN (arg_min(pv, pos) - arg_max(pv, pos)) * 100.0 / arg_min(pv, pos) ELSE 0.0 END AS drop_pct FROM "
              "(SELECT p_partkey, pos, coalesce(TRY_CAST(nullif(replace(regexp_extract(price, '[0-9,]+', 0), ',', ''), '') AS BIGINT), 0) AS pv FROM recent5) q GROUP BY 1)")


@register("e3_kpi_stats", "E3, C1, F11", views=("published", "recent5", "obsn"), sql=_with(_LOG) + f"""
SELECT count(*) AS total_tracked, count(*) FILTER (WHERE is_active) AS active_count,
       coalesce(CAST(floor(avg(price_value) FILTER (WHERE is_active AND price_value > 0)) AS BIGINT), 0) AS avg_price,
       count(*) FILTER (WHERE is_active AND discount <> '') AS discounted_count,
       count(*) FILTER (WHERE is_active AND coalesce(d.drop_pct, 0) > 0) AS price_drop_count,
       (SELECT new_listings_count FROM scanlog ORDER BY scan_date DESC LIMIT 1) AS new_count,
       (SELECT changed_properties_count FROM scanlog ORDER BY scan_date DESC LIMIT 1) AS changed_count,
       (SELECT max(scan_date) FROM scanlog) AS scan_date,
       (SELECT scan_date FROM scanlog ORDER BY scan_date DESC LIMIT 1 OFFSET 1) AS prev_scan_date
FROM published LEFT JOIN {_DROPS_SQL} d ON d.p_partkey = published.p_partkey""")
def e3_kpi_stats(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    drops = price_drop_pct(recent_prices(price_points(o, E), E), E)
    return RB.kpi_stats(C.published(spark, sf_dir), RB.scan_log(o, E), drops, E)


_NEWEST_NEW = "(SELECT max(fs) FROM (SELECT min(scan_date) AS fs FROM obsn GROUP BY p_partkey) x)"


@register("d10_new_listing_details", "D10", views=("published", "obsn"), sql=f"""
SELECT row_number() OVER (ORDER BY arrival) AS rank, p_partkey, title, price, auction_text FROM (
  SELECT n.p_partkey, n.arrival, p.title, p.price, p.auction_text
  FROM (SELECT p_partkey, min(obs_seq) AS arrival FROM obsn GROUP BY 1 HAVING min(scan_date) = {_NEWEST_NEW}
        ORDER BY arrival LIMIT 20) n
  JOIN published p ON p.p_partkey = n.p_partkey) z""")
def d10_new_listing_details(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    newest = RB.scan_new_entities(o, E).agg(F.max("scan_date").alias("d")).first()["d"]
    return RB.new_listing_details(o, C.published(spark, sf_dir), E, newest)


@register("d11_changes_by_property", "D11", views=("published", "obsn"), sql=_with() + """
SELECT p_partkey, count(*) AS n_changes, list_sort(list_distinct(list(type))) AS types FROM changes
WHERE scan_date = (SELECT max(scan_date) FROM obsn) AND p_partkey IN (SELECT p_partkey FROM published)
GROUP BY 1""")
def d11_changes_by_property(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    return RB.changes_by_property(o, C.published(spark, sf_dir), E, RB.latest_scan_date(o))


@register("d13_same_scheme", "D13, B21", views=("published",), sql="""
WITH cand AS (SELECT scheme_name AS s, p_partkey AS other, arrival AS oa FROM published WHERE NOT is_expired AND scheme_name <> ''),
src AS (SELECT p_partkey, scheme_name AS s FROM published WHERE scheme_name <> '')
SELECT p_partkey, rank, other FROM (
  SELECT src.p_partkey, cand.other, row_number() OVER (PARTITION BY src.p_partkey ORDER BY cand.oa) AS rank
  FROM src JOIN cand ON cand.s = src.s WHERE cand.other <> src.p_partkey) z
WHERE rank <= 10""")
def d13_same_scheme(spark, sf_dir):
    return R.same_scheme(C.published(spark, sf_dir), E).select(E, F.col("rank").cast("bigint").alias("rank"), "other")


_ACTD = ("(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY title, price_value, auction_text, address "
         "ORDER BY CASE WHEN size <> '' AND size <> 'Size not specified' THEN 0 ELSE 1 END, arrival) AS rn FROM published "
         "WHERE NOT is_expired) a WHERE rn = 1)")
_DAYQ = ("TRY_CAST(try_strptime(regexp_extract(auction_text, '(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})', 1) || ' ' || "
         "regexp_extract(auction_text, '(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})', 2) || ' ' || "
         "regexp_extract(auction_text, '(\\d{1,2})\\s+(\\w{3})\\s+(\\d{4})', 3), '%d %b %Y') AS DATE)")


@register("e6_auctions_per_week", "E6, D16", views=("published",), sql=f"""
WITH act AS {_ACTD},
st AS (SELECT CAST(date_trunc('week', TIMESTAMP '2001-10-01 00:00:00') AS DATE) AS s),
wk AS (SELECT CAST(floor(date_diff('day', (SELECT s FROM st), d) / 7) AS INTEGER) AS week
       FROM (SELECT {_DAYQ} AS d FROM act) x WHERE d IS NOT NULL),
cnt AS (SELECT week, count(*) AS n FROM wk WHERE week >= 0 AND week < 8 GROUP BY 1),
sp AS (SELECT CAST(range AS INTEGER) AS week FROM range(8))
SELECT sp.week, CAST((SELECT s FROM st) + sp.week * 7 AS DATE) AS week_start,
       CAST((SELECT s FROM st) + sp.week * 7 + 6 AS DATE) AS week_end, coalesce(cnt.n, 0) AS n,
       round(coalesce(cnt.n, 0) * 100.0 / greatest(max(coalesce(cnt.n, 0)) OVER (), 1), 0) AS pct_of_max,
       (CAST((SELECT s FROM st) + sp.week * 7 AS DATE) <= DATE '2001-10-01'
        AND DATE '2001-10-01' <= CAST((SELECT s FROM st) + sp.week * 7 + 6 AS DATE)) AS is_current_week
FROM sp LEFT JOIN cnt ON cnt.week = sp.week""")
def e6_auctions_per_week(spark, sf_dir):
    act = R.dedup_listings(C.published(spark, sf_dir).filter(~F.col("is_expired")))
    return R.auctions_per_week(act.withColumn("auction_day", parse_date_anywhere("auction_text")), C.AS_OF)


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(coalesce(CAST({x} AS VARCHAR), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def _nb(x: str) -> str:
    return f"coalesce({x}, '') <> ''"


def _card(old=False) -> str:
    title = _esc("coalesce(title, 'Untitled')")
    head = (f"CAST(rank AS VARCHAR) || '. <b>' || {title} || '</b>' || "
            f"CASE WHEN {_nb('location')} THEN ' — ' || {_esc('location')} ELSE '' END")
    addr = f"CASE WHEN {_nb('header_full')} THEN '   📍 ' || {_esc('header_full')} END"
    meta = ("CASE WHEN len(list_filter([CASE WHEN " + _nb("property_type") + " THEN " + _esc("property_type") + " END, CASE WHEN "
            + _nb("size") + " AND size <> 'Size not specified' THEN " + _esc("size") + " END, CASE WHEN " + _nb("discount") + " THEN "
            + _esc("discount") + " END], lambda v: v IS NOT NULL)) > 0 THEN '   🏷 ' || array_to_string(list_filter([CASE WHEN "
            + _nb("property_type") + " THEN " + _esc("property_type") + " END, CASE WHEN " + _nb("size")
            + " AND size <> 'Size not specified' THEN " + _esc("size") + " END, CASE WHEN " + _nb("discount") + " THEN "
            + _esc("discount") + " END], lambda v: v IS NOT NULL), ' · ') END")
    if old:
        pl = (f"CASE WHEN old_price IS NOT NULL OR new_price IS NOT NULL THEN '   💰 <s>' || {_esc('old_price')} || '</s> → <b>' || "
              f"{_esc('new_price')} || '</b>' END")
        dl = (f"CASE WHEN old_date IS NOT NULL OR new_date IS NOT NULL THEN '   📅 <s>' || {_esc('old_date')} || '</s> → <b>' || "
              f"{_esc('new_date')} || '</b>' END")
    else:
        pl = f"CASE WHEN {_nb('price')} THEN '   💰 ' || {_esc('price')} END"
        dl = f"CASE WHEN {_nb('auction_date')} THEN '   📅 ' || {_esc('auction_date')} END"
    return f"concat_ws(chr(10), {head}, {addr}, {meta}, {pl}, {dl}) || chr(10)"


_G10_CTES = """lastscan AS (SELECT max(scan_date) AS d FROM obsn),
newe AS (SELECT p_partkey, min(obs_seq) AS arrival FROM obsn GROUP BY 1 HAVING min(scan_date) = (SELECT d FROM lastscan)),
lc AS (SELECT *, min(obs_seq) OVER (PARTITION BY p_partkey) AS arrival, max(obs_seq) OVER (PARTITION BY p_partkey) AS lastseq
       FROM changes WHERE scan_date = (SELECT d FROM lastscan)),
chg AS (SELECT p_partkey, arrival,
               max(old_value) FILTER (WHERE type = 'price_change') AS old_price,
               max(new_value) FILTER (WHERE type = 'price_change') AS new_price,
               max(old_value) FILTER (WHERE type = 'auction_date_change') AS old_date,
               max(new_value) FILTER (WHERE type = 'auction_date_change') AS new_date
        FROM lc WHERE obs_seq = lastseq GROUP BY 1, 2),
nt AS (SELECT *, row_number() OVER (ORDER BY arrival) AS rank FROM newe),
ct AS (SELECT *, row_number() OVER (ORDER BY arrival) AS rank FROM chg)"""


@register("g10_scan_digest", "G10, B29", views=("statet", "obsn"), sql=_with(_G10_CTES) + f"""
SELECT 'new' AS section, rank, s.p_partkey, {_card(False)} AS text
FROM nt JOIN statet s ON s.p_partkey = nt.p_partkey WHERE rank <= 5
UNION ALL
SELECT 'changed', rank, s.p_partkey, {_card(True)} FROM ct JOIN statet s ON s.p_partkey = ct.p_partkey WHERE rank <= 5
UNION ALL
SELECT 'new_count', 0, NULL, 'NEW (' || (SELECT count(*) FROM newe) || ')'
       || CASE WHEN (SELECT count(*) FROM newe) > 5 THEN ' +' || ((SELECT count(*) FROM newe) - 5) || ' more' ELSE '' END
UNION ALL
SELECT 'changed_count', 0, NULL, 'CHANGES (' || (SELECT count(*) FROM chg) || ')'
       || CASE WHEN (SELECT count(*) FROM chg) > 5 THEN ' +' || ((SELECT count(*) FROM chg) - 5) || ' more' ELSE '' END""")
def g10_scan_digest(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    out = RB.scan_digest(o, C.state(spark, sf_dir), E, RB.latest_scan_date(o))
    return out.select("section", F.col("rank").cast("bigint").alias("rank"), E, "text")
