"""Catalog: array, record and JSON helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators.history import current_state
from . import context as C
from .registry import register
from .sqlviews import register_published

register_published()


@register("i1_i3_i4_history_arrays", "I1, I3, I4", views=("published", "rounds"), sql="""
SELECT p.p_partkey, n_ph + 1 AS n_ph_appended,
       coalesce((SELECT list(day ORDER BY pos) FROM rounds r WHERE r.p_partkey = p.p_partkey AND r.pos > r2.n - 3), []) AS last3_days,
       length(to_json({'title': p.title, 'price': p.price, 'location': p.location})) AS json_len
FROM published p LEFT JOIN (SELECT p_partkey, count(*) AS n FROM rounds GROUP BY 1) r2 ON r2.p_partkey = p.p_partkey""")
def i1_i3_i4_history_arrays(spark, sf_dir):
    pub = C.published(spark, sf_dir)
    item = F.struct(F.lit(0).alias("pos"), F.col("price").alias("p"), F.lit("").alias("d"), F.lit("").alias("u"))
    js = A.export_json(pub, "p_partkey", ["title", "price", "location"]).withColumnRenamed("json", "_json")
    return pub.join(js, "p_partkey").select(
        "p_partkey",
        F.size(A.append_history("ph", item)).cast("bigint").alias("n_ph_appended"),
        F.transform(A.slice_last("hist", 3), lambda x: x["d"]).alias("last3_days"),
        F.length("_json").cast("bigint").alias("json_len"),
    )


MERGE_FIELDS = ("title", "price", "auction_date", "discount", "header_full")


@register("i2_merge_records", "I2, F4", views=("obsn",), sql="""
WITH lastobs AS (SELECT p_partkey, max(obs_seq) AS s FROM obsn GROUP BY 1),
newr AS (SELECT o.* FROM obsn o JOIN lastobs l ON l.p_partkey = o.p_partkey AND l.s = o.obs_seq),
oldr AS (SELECT o.p_partkey,
                arg_max(title, o.obs_seq) FILTER (WHERE title IS NOT NULL) AS title,
                arg_max(price, o.obs_seq) FILTER (WHERE price IS NOT NULL) AS price,
                arg_max(auction_date, o.obs_seq) FILTER (WHERE auction_date IS NOT NULL) AS auction_date,
                arg_max(discount, o.obs_seq) FILTER (WHERE discount IS NOT NULL) AS discount,
                arg_max(header_full, o.obs_seq) FILTER (WHERE header_full IS NOT NULL) AS header_full
         FROM obsn o JOIN lastobs l ON l.p_partkey = o.p_partkey WHERE o.obs_seq < l.s GROUP BY 1)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey,
       CASE WHEN starts_with(coalesce(n.title, ''), 'Property Listing') AND o.title IS NOT NULL THEN o.title
            ELSE coalesce(n.title, o.title) END AS title,
       coalesce(n.price, o.price) AS price, coalesce(n.auction_date, o.auction_date) AS auction_date,
       coalesce(n.discount, o.discount) AS discount, coalesce(n.header_full, o.header_full) AS header_full
FROM oldr o FULL OUTER JOIN newr n ON n.p_partkey = o.p_partkey""")
def i2_merge_records(spark, sf_dir):
    o = C.obsn(spark, sf_dir)
    last = o.groupBy("p_partkey").agg(F.max("obs_seq").alias("_s"))
    tagged = o.join(last, "p_partkey")
    new = tagged.filter(F.col("obs_seq") == F.col("_s")).drop("_s")
    old = current_state(tagged.filter(F.col("obs_seq") < F.col("_s")).drop("_s"), "p_partkey")
    return A.merge_records(old, new, "p_partkey", MERGE_FIELDS)
