"""Catalog: market aggregates (E) over the latest state."""

from __future__ import annotations

from ..operators import market
from . import context as C
from .registry import register

# B12 in SQL: all digits and dots as a double, 0 when not a number.
SQL_PRICE_ALL = "coalesce(TRY_CAST(nullif(regexp_replace(coalesce(price, ''), '[^0-9.]', '', 'g'), '') AS DOUBLE), 0.0)"


@register("e1_market_summary", "E1, B12", views=("statet",), sql=f"""
SELECT coalesce(property_type, 'Other') AS property_type,
       count(*) AS listing_count,
       count(*) FILTER (WHERE p > 0) AS priced_count,
       coalesce(avg(p) FILTER (WHERE p > 0), 0.0) AS avg_price,
       coalesce(min(p) FILTER (WHERE p > 0), 0.0) AS min_price,
       coalesce(max(p) FILTER (WHERE p > 0), 0.0) AS max_price
FROM (SELECT property_type, {SQL_PRICE_ALL} AS p FROM statet) s
GROUP BY 1
""")
def e1_market_summary(spark, sf_dir):
    return market.market_summary(C.state(spark, sf_dir))

