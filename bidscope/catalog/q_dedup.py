"""Catalog: entity grouping of the property database."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.dedup import dedup_report, group_entities
from . import context as C
from .registry import register
from .sqlviews import (
    EVENT_DATE, sql_is_expired, sql_norm_address, sql_norm_size, sql_norm_text, sql_strip, view,
)


def _lastnn(c: str) -> str:
    return f"arg_max({c}, obs_seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"


view("praw_obs", """
SELECT *, CAST(p_partkey AS VARCHAR) || '|' || coalesce(listing_id, '') AS entry_id FROM obsn
""", ("obsn",))

view("praw", f"""
SELECT entry_id, any_value(p_partkey) AS p_partkey, {_lastnn('title')}, {_lastnn('location')}, {_lastnn('size')},
       {_lastnn('header_short')}, {_lastnn('header_full')}, {_lastnn('listing_id')}, {_lastnn('price')},
       {_lastnn('price_value')}, {_lastnn('auction_date')}, {_lastnn('discount')}, {_lastnn('last_updated')},
       arg_min({EVENT_DATE}, obs_seq) AS first_seen, min(obs_seq) AS arrival
FROM praw_obs GROUP BY entry_id
""", ("praw_obs",))

view("praw_pp", f"""
SELECT entry_id, price, date, row_number() OVER (PARTITION BY entry_id ORDER BY scan_date, obs_seq) AS pos FROM (
  SELECT entry_id, scan_date, obs_seq, coalesce(price, '') AS price, {EVENT_DATE} AS date,
         lag(coalesce(price, '')) OVER (PARTITION BY entry_id ORDER BY scan_date, obs_seq) AS prev FROM praw_obs) t
WHERE prev IS NULL OR prev <> price
""", ("praw_obs",))

view("praw_ap", f"""
SELECT entry_id, auction_date, date, row_number() OVER (PARTITION BY entry_id ORDER BY scan_date, obs_seq) AS pos FROM (
  SELECT entry_id, scan_date, obs_seq, coalesce(auction_date, '') AS auction_date, {EVENT_DATE} AS date,
         lag(coalesce(auction_date, '')) OVER (PARTITION BY entry_id ORDER BY scan_date, obs_seq) AS prev FROM praw_obs) t
WHERE prev IS NULL OR prev <> auction_date
""", ("praw_obs",))

_GENERIC = " OR ".join(f"regexp_matches(coalesce(title, ''), '{p}')" for p in (
    "(?i)^\\d+(\\.\\d+)?\\s+Storey\\s+", "(?i)^Office\\s+(Unit|Lot)$", "(?i)^Shop\\s+(Lot|Unit)$", "(?i)^Warehouse$", "(?i)^Factory$"))
_HAS_SIZE = "(coalesce(size, '') <> '' AND size <> 'Size not specified')"
_ADDR = sql_norm_address("coalesce(nullif(header_full, ''), '')")
_SCORE = ("(CASE WHEN coalesce(listing_id, '') <> '' THEN 100 ELSE 0 END + CASE WHEN coalesce(header_full, '') <> '' THEN 50 ELSE 0 END"
          f" + CASE WHEN {_HAS_SIZE} THEN 20 ELSE 0 END + CASE WHEN coalesce(header_short, '') <> '' THEN 10 ELSE 0 END"
          " + CASE WHEN coalesce(title, '') <> '' AND NOT starts_with(title, 'Property Listing') THEN 30 ELSE 0 END)")

view("dd_e", f"""
SELECT *, {_ADDR} AS addr, {sql_norm_size('size')} AS nsize, {sql_norm_text('title')} AS ntitle, {_SCORE} AS score,
       (coalesce(listing_id, '') = '' AND NOT length({_ADDR}) > 20
        AND (starts_with(coalesce(title, ''), 'Property Listing') OR (NOT {_HAS_SIZE} AND ({_GENERIC})))) AS junk
FROM praw
""", ("praw",))

view("dd_lid", """
SELECT e.*, listing_id || '|' || nsize AS gk, min(arrival) OVER (PARTITION BY listing_id || '|' || nsize) AS g_arr
FROM dd_e e WHERE NOT junk AND coalesce(listing_id, '') <> ''
""", ("dd_e",))

view("dd_n2", """
SELECT n.*, coalesce(x.gk, y.gk) AS gk2 FROM (SELECT * FROM dd_e WHERE NOT junk AND coalesce(listing_id, '') = '') n
LEFT JOIN (SELECT addr AS ia, nsize AS isz, arg_max(gk, (g_arr, arrival)) AS gk FROM dd_lid
           WHERE length(addr) > 20 AND nsize <> '' GROUP BY 1, 2) x
  ON x.ia = n.addr AND x.isz = n.nsize AND n.addr <> '' AND n.nsize <> ''
LEFT JOIN (SELECT addr AS ja, arg_max(gk, (g_arr, arrival)) AS gk FROM dd_lid WHERE length(addr) > 20 GROUP BY 1) y
  ON y.ja = n.addr AND n.addr <> '' AND n.nsize = ''
""", ("dd_lid",))

view("dd_m12", """
SELECT entry_id, gk, g_arr, 1 AS phase, 0 AS s, arrival, score, ntitle, nsize FROM dd_lid
UNION ALL
SELECT n.entry_id, n.gk2, g.g_arr, 2, 0, n.arrival, n.score, n.ntitle, n.nsize
FROM dd_n2 n JOIN (SELECT DISTINCT gk, g_arr FROM dd_lid) g ON g.gk = n.gk2 WHERE n.gk2 IS NOT NULL
""", ("dd_n2",))

view("dd_rest", f"""
SELECT *, min(arrival) OVER (PARTITION BY sk) AS s_arr FROM (
  SELECT *, ntitle || '|' || {sql_norm_text('location')} || '|' || nsize || '|' || addr AS sk FROM dd_n2 WHERE gk2 IS NULL) r
""", ("dd_n2",))

view("dd_lts", """
SELECT ntitle AS lt, nsize AS ls, arg_min(gk, g_arr) AS gk4 FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gk ORDER BY score DESC, phase, s, arrival) AS rn FROM dd_m12) b
  WHERE rn = 1 AND ntitle <> '' AND NOT starts_with(ntitle, 'property listing') AND nsize <> '') q
GROUP BY 1, 2
""", ("dd_m12",))

view("dd_members", """
WITH bsk AS (SELECT sk, ntitle, nsize FROM (
               SELECT *, row_number() OVER (PARTITION BY sk ORDER BY score DESC, arrival) AS rn FROM dd_rest) b WHERE rn = 1),
mv AS (SELECT bsk.sk, l.gk4 FROM bsk JOIN dd_lts l ON l.lt = bsk.ntitle AND l.ls = bsk.nsize),
gord AS (SELECT DISTINCT gk, g_arr FROM dd_lid)
SELECT entry_id, 'id:' || gk AS group_id, 'id' AS group_kind, 0 AS gk_k, g_arr AS g_o, phase, s, arrival, score FROM dd_m12
UNION ALL
SELECT r.entry_id, 'id:' || mv.gk4, 'id', 0, gord.g_arr, 4, r.s_arr, r.arrival, r.score
FROM dd_rest r JOIN mv ON mv.sk = r.sk JOIN gord ON gord.gk = mv.gk4
UNION ALL
SELECT r.entry_id, 'key:' || r.sk, 'key', 1, r.s_arr, 3, 0, r.arrival, r.score
FROM dd_rest r WHERE r.sk NOT IN (SELECT sk FROM mv)
""", ("dd_rest", "dd_lts", "dd_lid", "dd_m12"))

_ANY_S = sql_strip("regexp_replace(coalesce(p.auction_date, ''), '\\s*\\(.*?\\)\\s*', ' ', 'g')")
_ANY_DAY = (f"coalesce(TRY_CAST(try_strptime({_ANY_S}, '%d %b %Y') AS DATE), TRY_CAST(try_strptime({_ANY_S}, '%d %B %Y') AS DATE), "
            f"CASE WHEN regexp_matches({_ANY_S}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN TRY_CAST(try_strptime({_ANY_S}, '%Y-%m-%d') AS DATE) END)")
_CLEAN = "regexp_replace(coalesce({c}, ''), '[^\\pL\\pN_\\s]', '', 'g')"
_SLUG_BASE = ("lower(regexp_replace(" + sql_strip(" || '_' || ".join(_CLEAN.format(c=c) for c in ("title", "location", "size")))
              + ", '\\s+', '_', 'g'))")
_SLUG = f"CASE WHEN {_SLUG_BASE} = '' THEN 'property' ELSE substr({_SLUG_BASE}, 1, 120) END"

view("dd_groups", f"""
WITH best AS (
  SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, phase, s, arrival) AS rn
                 FROM dd_members m) b WHERE rn = 1),
bounds AS (
  SELECT m.group_id, min(coalesce(nullif(p.first_seen, ''), nullif(p.last_updated, ''), '')) AS first_seen,
         max(coalesce(nullif(p.last_updated, ''), nullif(p.first_seen, ''), '')) AS last_updated, count(*) AS n_members
  FROM dd_members m JOIN praw p ON p.entry_id = m.entry_id GROUP BY 1),
g AS (
  SELECT b.group_id, b.group_kind, b.gk_k, b.g_o, b.entry_id AS best_entry, bd.n_members, p.title, p.location, p.size,
         p.header_short, p.header_full, p.listing_id, p.price, p.auction_date, bd.first_seen, bd.last_updated,
         {_SLUG.replace('coalesce(title', 'coalesce(p.title').replace('coalesce(location', 'coalesce(p.location').replace('coalesce(size', 'coalesce(p.size')} AS slug0,
         {sql_norm_text('p.title')} || '|' || {sql_norm_text('p.location')} || '|' || {sql_norm_size('p.size')} || '|'
           || {sql_norm_address("coalesce(nullif(p.header_full, ''), '')")} AS stable_key,
         CASE WHEN contains(coalesce(p.header_short, ''), ',') THEN {sql_strip("regexp_extract(p.header_short, '^(.*),', 1)")} ELSE '' END AS scheme_name,
         {sql_is_expired('p.auction_date')} AS is_expired,
         coalesce({_ANY_DAY} >= DATE '2001-10-01', false) AS is_active_dedup
  FROM best b JOIN bounds bd ON bd.group_id = b.group_id JOIN praw p ON p.entry_id = b.entry_id),
s1 AS (SELECT *, row_number() OVER (PARTITION BY slug0 ORDER BY gk_k, g_o) AS n1 FROM g),
s2 AS (SELECT *, CASE WHEN n1 = 1 THEN slug0 ELSE slug0 || '_' || n1 END AS slug1 FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY slug1 ORDER BY n1, gk_k, g_o) AS n2 FROM s2)
SELECT *, CASE WHEN n2 = 1 THEN slug1 ELSE slug1 || '_' || n2 END AS slug FROM s3
""", ("dd_members", "praw"))

GROUP_COLS = ("group_id", "group_kind", "best_entry", "n_members", "title", "location", "size", "header_short",
              "header_full", "listing_id", "price", "auction_date", "first_seen", "last_updated", "stable_key",
              "scheme_name", "is_expired", "slug")


def _run(spark, sf_dir):
    entries, pp, ap = C.properties_raw(spark, sf_dir)
    return entries, group_entities(entries, pp, ap, C.AS_OF)


@register("f14_group_entities", "F14, F6, F7, E7, H1, B3, B5, B19", views=("dd_groups",),
          sql=f"SELECT {', '.join(GROUP_COLS)} FROM dd_groups")
def f14_group_entities(spark, sf_dir):
    _, (g, _m, _ph, _ah) = _run(spark, sf_dir)
    return g.select(*GROUP_COLS)


@register("d14_d15_group_members", "C14, D14, D15", views=("dd_members",),
          sql="SELECT entry_id, group_id, group_kind, phase FROM dd_members")
def d14_d15_group_members(spark, sf_dir):
    _, (_g, m, _ph, _ah) = _run(spark, sf_dir)
    return m.select("entry_id", "group_id", "group_kind", "phase")


def _merged_sql(value: str, pts: str) -> str:
    return f"""
WITH mem AS (SELECT m.entry_id, m.group_id, m.phase, m.s, m.arrival,
                    coalesce(nullif(p.last_updated, ''), p.first_seen) AS cur_date, p.{value} AS cur
             FROM dd_members m JOIN praw p ON p.entry_id = m.entry_id),
pts AS (
  SELECT mem.group_id, x.{value} AS v, coalesce(x.date, '') AS date, mem.phase, mem.s, mem.arrival, x.pos AS p
  FROM {pts} x JOIN mem ON mem.entry_id = x.entry_id
  UNION ALL
  SELECT group_id, cur, coalesce(cur_date, ''), phase, s, arrival, 1099511627776 FROM mem WHERE coalesce(cur, '') <> ''),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, v, date ORDER BY phase, s, arrival, p) AS rn FROM pts) q WHERE rn = 1),
ordered AS (SELECT *, lag(v) OVER (PARTITION BY group_id ORDER BY date, phase, s, arrival, p) AS prev,
                   row_number() OVER (PARTITION BY group_id ORDER BY date, phase, s, arrival, p) AS k FROM firsts)
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY date, phase, s, arrival, p) AS pos, v AS {value}, date
FROM ordered WHERE k = 1 OR v IS DISTINCT FROM prev"""


@register("f5_merge_price_history", "F5", views=("dd_members", "praw", "praw_pp"), sql=_merged_sql("price", "praw_pp"))
def f5_merge_price_history(spark, sf_dir):
    _, (_g, _m, ph, _ah) = _run(spark, sf_dir)
    return ph.select("group_id", F.col("pos").cast("bigint").alias("pos"), "price", "date")


@register("f5_merge_auction_history", "F5", views=("dd_members", "praw", "praw_ap"), sql=_merged_sql("auction_date", "praw_ap"))
def f5_merge_auction_history(spark, sf_dir):
    _, (_g, _m, _ph, ah) = _run(spark, sf_dir)
    return ah.select("group_id", F.col("pos").cast("bigint").alias("pos"), "auction_date", "date")


@register("e8_dedup_report", "E8, C14, H1", views=("dd_groups", "dd_members", "dd_e"), sql="""
SELECT (SELECT count(*) FROM dd_e) AS input, (SELECT count(*) FROM dd_e WHERE junk) AS junk,
       (SELECT count(DISTINCT group_id) FROM dd_members WHERE phase = 1) AS id_groups_phase1,
       (SELECT count(*) FROM dd_members WHERE phase IN (2, 3, 4)) AS without_id,
       (SELECT count(*) FROM dd_members WHERE phase = 2) AS cross_matched_address,
       (SELECT count(*) FROM dd_members WHERE phase = 4) AS cross_matched_title_size,
       count(*) FILTER (WHERE group_kind = 'id') AS id_groups, count(*) FILTER (WHERE group_kind = 'key') AS key_groups,
       count(*) AS output,
       CASE WHEN (SELECT count(*) FROM dd_e) = 0 THEN 0.0
            ELSE round(100.0 - count(*) * 100.0 / (SELECT count(*) FROM dd_e), 1) END AS reduction_pct,
       count(*) FILTER (WHERE is_active_dedup) AS active, count(*) - count(*) FILTER (WHERE is_active_dedup) AS expired
FROM dd_groups""")
def e8_dedup_report(spark, sf_dir):
    entries, (g, m, _ph, _ah) = _run(spark, sf_dir)
    return dedup_report(entries, m, g)
