"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; a line is boilerplate of a host where the share of the host's pages that hold it exceeds a
ratio. Lines are counted by a 128-bit hash, once per page. A page has few lines, so a host has at most (lines of
a page / ratio) boilerplate lines: a short list that is joined to the host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RATIO = 0.08
MIN_PAGES = 5
#: White space at the ends of a line doesn't count.
BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    """The hash that stands for a line."""
    return F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary"))


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """Rows ``(__host, __lines)``: the hashes of each host's boilerplate lines."""
    pages = df.select(F.col(host_col).alias("__host"), F.col(text_col).alias("_text"))
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), line_key))
    lines = pages.select("__host", F.explode(keys).alias("_line")).groupBy("__host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    found = lines.alias("l").join(totals.alias("t"), F.col("l.__host").eqNullSafe(F.col("t.__host"))).where(F.col("_n") / F.col("_pages") > ratio)
    return found.groupBy(F.col("l.__host").alias("__host")).agg(F.sort_array(F.collect_list("_line")).alias("__lines"))


def dedup_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with ``text_col`` freed of boilerplate lines, and ``n_lines`` and ``n_dropped`` (longs).

    A line is dropped where more than ``ratio`` of its host's rows, and at least ``min_pages`` of them, hold it; white space at
    its ends does not count, and blank lines are never dropped. The other lines stay as they are and in order. A null text
    stays null (0 lines) and an empty one empty (1 line); all rows count as pages. Rows with a null host form one host. Repeated
    rows are pages of their own; columns with the new names are replaced; an empty table stays empty.
    """
    base = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_lines", "n_dropped")))
    found = stored(boilerplate(base, host_col, text_col, ratio, min_pages), "boilerplate")
    both = base.join(found, F.col(f"`{host_col}`").eqNullSafe(F.col("__host")), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__lines"), line_key(x)))
    both = both.withColumn("__kept", F.when(F.col("__lines").isNotNull(), kept))
    n = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(lines))
    out = [F.coalesce(F.array_join("__kept", "\n"), F.col(f"`{text_col}`")).alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in base.columns]
    return both.select(*out, n.cast("long").alias("n_lines"), F.when(F.col("__kept").isNotNull(), n - F.size("__kept")).otherwise(0).cast("long").alias("n_dropped"))


def sql(table: str = "documents", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for ``(doc_id, n_lines, n_dropped, kept_sha256)``."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
WITH pages AS (SELECT {host} AS host, count(*) AS n FROM {table} GROUP BY 1),
lines AS (SELECT doc_id, {host} AS host, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS pos FROM {table} WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, {blanks}) AS k FROM lines),
counted AS (SELECT host, k, count(DISTINCT doc_id) AS n FROM keyed WHERE k <> '' GROUP BY 1, 2),
drops AS (SELECT c.host, c.k FROM counted c JOIN pages p ON c.host IS NOT DISTINCT FROM p.host
          WHERE c.n >= {min_pages} AND c.n::DOUBLE / p.n > {ratio}),
judged AS (SELECT l.doc_id, l.line, l.pos, d.k IS NOT NULL AS gone
           FROM keyed l LEFT JOIN drops d ON l.host IS NOT DISTINCT FROM d.host AND l.k = d.k),
texts AS (SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_dropped,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM judged GROUP BY 1)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_dropped, 0)::BIGINT AS n_dropped,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM {table} d LEFT JOIN texts t ON d.doc_id = t.doc_id"""
