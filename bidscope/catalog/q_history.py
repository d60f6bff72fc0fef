"""Catalog: per-entity history (F1, F2, F4, F8, F9, F11-F13), keyed by the true entity p_partkey."""

from __future__ import annotations

from ..operators import history as H
from . import context as C
from .registry import register
from .sqlviews import EVENT_DATE, sql_price_value, sql_stable_key, sql_type

E = C.ENTITY


@register("f1_price_points", "F1", views=("price_pts",), sql="""
SELECT p_partkey, scan_date, price, date, url FROM price_pts
""")
def f1_price_points(spark, sf_dir):
    return H.price_points(C.obsn(spark, sf_dir), E).drop("obs_seq")


@register("f1_auction_points", "F1", views=("auction_pts",), sql="""
SELECT p_partkey, scan_date, auction_date, date FROM auction_pts
""")
def f1_auction_points(spark, sf_dir):
    return H.auction_points(C.obsn(spark, sf_dir), E).drop("obs_seq")


@register("f2_detect_changes", "F2", views=("obsn",), sql=f"""
WITH t AS (
  SELECT p_partkey, scan_date, {EVENT_DATE} AS change_date,
         coalesce(price, '') AS price, coalesce(auction_date, '') AS ad,
         lag(coalesce(price, '')) OVER w AS prev_price, lag(coalesce(auction_date, '')) OVER w AS prev_ad
  FROM obsn WINDOW w AS (PARTITION BY p_partkey ORDER BY scan_date, obs_seq))
SELECT p_partkey, scan_date, 'price_change' AS type, 'Auction Price' AS field, prev_price AS old_value,
       price AS new_value, change_date FROM t WHERE prev_price IS NOT NULL AND prev_price <> price
UNION ALL
SELECT p_partkey, scan_date, 'auction_date_change', 'Auction Date', prev_ad, ad, change_date
FROM t WHERE prev_ad IS NOT NULL AND prev_ad <> ad
""")
def f2_detect_changes(spark, sf_dir):
    return H.detect_changes(C.obsn(spark, sf_dir), E).drop("obs_seq")


@register("f4_current_state", "F4, B4, B9", views=("state", "obsn"), sql=f"""
SELECT s.p_partkey, title, location, size, header_short, header_full, listing_id, price, price_value,
       auction_date, discount, last_updated, first_seen, k.stable_key, first_scan, last_scan, n_obs,
       {sql_type('title')} AS property_type
FROM state s JOIN (SELECT p_partkey, arg_min({sql_stable_key()}, obs_seq) AS stable_key FROM obsn GROUP BY 1) k
  ON k.p_partkey = s.p_partkey
""")
def f4_current_state(spark, sf_dir):
    return C.state(spark, sf_dir).drop("last_obs_seq", "first_obs_seq")


@register("f8_history_rounds", "F8", views=("rounds",), sql="""
SELECT p_partkey, pos, day, price, auction_date, url FROM rounds
""")
def f8_history_rounds(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    return H.history_rounds(H.price_points(o, E), H.auction_points(o, E), E)


@register("f9_recent_prices", "F9, B13", views=("recent5",), sql="""
SELECT p_partkey, pos, price, day, url, n_kept FROM recent5
""")
def f9_recent_prices(spark, sf_dir):
    return H.recent_prices(H.price_points(C.obsn(spark, sf_dir), E), E)


@register("f11_price_drop", "F11", views=("recent5",), sql=f"""
SELECT p_partkey,
       CASE WHEN count(*) >= 2 AND arg_min(pv, pos) > 0 AND arg_max(pv, pos) > 0 AND arg_max(pv, pos) < arg_min(pv, pos)
            THEN (arg_min(pv, pos) - arg_max(pv, pos)) * 100.0 / arg_min(pv, pos) ELSE 0.0 END AS drop_pct
FROM (SELECT p_partkey, pos, {sql_price_value('price')} AS pv FROM recent5) t GROUP BY 1
""")
def f11_price_drop(spark, sf_dir):
    return H.price_drop_pct(H.recent_prices(H.price_points(C.obsn(spark, sf_dir), E), E), E)


@register("f12_round_changes", "F12", views=("rounds",), sql="""
SELECT p_partkey, pos, day, price, auction_date, url,
       pos > 1 AND price IS DISTINCT FROM lag(price) OVER w AS price_changed,
       pos > 1 AND auction_date IS DISTINCT FROM lag(auction_date) OVER w AS date_changed
FROM rounds WINDOW w AS (PARTITION BY p_partkey ORDER BY pos)
""")
def f12_round_changes(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    return H.round_changes(H.history_rounds(H.price_points(o, E), H.auction_points(o, E), E), E)


@register("f13_price_series", "F13", views=("recent5",), sql=f"""
SELECT p_partkey, pos, pv AS price_value,
       round((pv - mn) / CASE WHEN mx - mn = 0 THEN 1 ELSE mx - mn END, 6) AS scaled,
       CASE WHEN lst <= fst THEN 'down' ELSE 'up' END AS direction
FROM (SELECT p_partkey, pos, pv, min(pv) OVER w AS mn, max(pv) OVER w AS mx, count(*) OVER w AS n,
             first_value(pv) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fst,
             last_value(pv) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lst
      FROM (SELECT p_partkey, pos, {sql_price_value('price')} AS pv FROM recent5 WHERE {sql_price_value('price')} > 0) v
      WINDOW w AS (PARTITION BY p_partkey)) t
WHERE n >= 2
""")
def f13_price_series(spark, sf_dir):
    return H.price_series(H.recent_prices(H.price_points(C.obsn(spark, sf_dir), E), E), E)
