"""Sorting, paging, top-k and first-per-key.

* first-per-key uses ``min_by(struct(row), order)`` in a groupBy: partial aggregation, so a key holding a
  third of the rows is combined map-side instead of landing in one task.
* global top-k uses ``orderBy().limit()`` (TakeOrderedAndProject: a bounded heap per partition).
* per-key top-k uses ``row_number() <= k``, which Spark turns into a WindowGroupLimit applied before the
  shuffle as well as after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import days_until, discount_value, size_value


def first_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """The first row (by ``order``) of every key; skew-safe aggregate instead of a window."""
    cols = df.columns
    ordkey = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), ordkey).alias("_row"))
    return agg.select("_row.*")


def dedup_listings(published: DataFrame) -> DataFrame:
    """first row per (title, price_value, auction_text, address), preferring rows with a size (Q3, the
    intent), then arrival order."""
    has_size = (F.coalesce(F.col("size"), F.lit("")) != "") & (F.col("size") != "Size not specified")
    keys = [F.coalesce(F.col(c), F.lit("")).alias(f"_k_{c}") for c in ("title", "auction_text", "address")]
    keys.append(F.coalesce(F.col("price_value"), F.lit(0)).alias("_k_pv"))
    with_keys = published.select("*", *keys)
    out = first_per_key(with_keys, ["_k_title", "_k_pv", "_k_auction_text", "_k_address"],
                        [F.when(has_size, 0).otherwise(1), F.col("arrival")])
    return out.drop("_k_title", "_k_pv", "_k_auction_text", "_k_address")


def _tie() -> list[Column]:
    return [F.col("arrival").asc()]


def listing_sort_order(key: str, as_of) -> list[Column]:
    """G1: price_asc (default, also for unknown keys), price_desc, date_asc, discount, size_desc, size_asc;
    arrival order breaks ties (the reference's sorts are stable)."""
    pv = F.coalesce(F.col("price_value"), F.lit(0))
    size = size_value("size")  # the sort variant of B15 (integer of the first digits/commas run, else 0)
    orders = {
        "price_asc": [pv.asc()],
        "price_desc": [pv.desc()],
        "date_asc": [days_until("auction_text", as_of).asc()],
        "discount": [discount_value("discount").desc()],
        "size_desc": [size.desc()],
        "size_asc": [size.asc()],
    }
    return orders.get(key, orders["price_asc"]) + _tie()


def listing_sort_key(key: str, as_of) -> Column:
    """G1 as one number that rises in the order of the sort, so that specs with different sorts share a window."""
    pv = F.coalesce(F.col("price_value"), F.lit(0))
    keys = {"price_asc": pv, "price_desc": -pv, "date_asc": days_until("auction_text", as_of), "discount": -discount_value("discount"), "size_desc": -size_value("size"), "size_asc": size_value("size")}
    return keys.get(key, pv).cast("double")


def rank_by_spec(df: DataFrame, specs: dict[str, tuple[Column, Column]], tie: str, upto: int, keep: list[str], after: dict[str, tuple[float, int]] | None = None) -> DataFrame:
    """Many queries over one table in one pass: ``(spec, rank, total, sort_key, tie, *keep)`` of the first ``upto`` rows of each spec, given as
    ``name: (condition, sort key)`` and ordered by the key and ``tie``.

    A row goes to every spec whose condition it meets; a limit per spec keeps ``upto`` of them in each task before the shuffle, and the totals are
    counts that combine map-side. ``after`` gives, by spec, the sort key and tie of the row where the page before ended: the ranks
    then begin after it, and no task holds the pages in between.
    """
    hits = []
    for name, (cond, key) in specs.items():
        later = F.lit(True)
        if after and name in after:
            last_key, last_tie = after[name]
            later = (key > last_key) | ((key == last_key) & (F.col(tie) > last_tie))
        hits.append(F.when(cond, F.struct(F.lit(name).alias("spec"), key.alias("sort_key"), later.alias("later"))))
    rows = df.select(tie, *keep, F.explode(F.array_compact(F.array(*hits))).alias("_s")).select("_s.spec", "_s.sort_key", "_s.later", tie, *keep)
    totals = rows.groupBy("spec").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("spec").orderBy("sort_key", tie)
    first = rows.where("later").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= upto)
    return first.join(totals, "spec").select("spec", F.col("rank").cast("bigint").alias("rank"), "total", "sort_key", tie, *keep)


def table_sort_order(col: str, direction: str, as_of) -> list[Column]:
    """Title, price, type, location, size, auction (default), discount; asc or desc."""
    exprs = {
        "title": F.coalesce(F.col("title"), F.lit("")),
        "price": F.coalesce(F.col("price_value"), F.lit(0)),
        "type": F.coalesce(F.col("property_type"), F.lit("")),
        "location": F.coalesce(F.col("location"), F.lit("")),
        "size": size_value("size"),
        "auction": days_until("auction_text", as_of),
        "discount": discount_value("discount"),
    }
    e = exprs.get(col, exprs["auction"])
    return [e.desc() if direction == "desc" else e.asc()] + _tie()


def page(df: DataFrame, order: list[Column], page_no: int = 1, page_size: int = 20) -> DataFrame:
    """Rows of page ``page_no`` (1-based) in ``order``, with their 1-based rank. Page sizes in the
    reference: 20 cards, 50 table rows, 12 map rows."""
    start = (page_no - 1) * page_size
    rows = df.orderBy(*order).offset(start).limit(page_size) if start else df.orderBy(*order).limit(page_size)
    # rank within the page: the page is at most page_size rows, so this window is bounded
    w = Window.orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w) + F.lit(start))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k with 1-based rank (bounded: the window runs over the k rows that remain)."""
    rows = df.orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_k_per_key(df: DataFrame, keys, order: list[Column], k: int) -> DataFrame:
    """First k rows of every key by ``order`` with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hot_deals(active: DataFrame, k: int = 5) -> DataFrame:
    """Active rows with a discount, largest discount first."""
    d = active.filter(F.coalesce(F.col("discount"), F.lit("")) != "")
    return top_k(d, [discount_value("discount").desc()] + _tie(), k)


def _notable(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    # dedup by (title, price_value, auction_text) keeping the best row by the list's own order, then top k
    keys = [F.coalesce(F.col("title"), F.lit("")).alias("_nt"), F.coalesce(F.col("price_value"), F.lit(0)).alias("_np"),
            F.coalesce(F.col("auction_text"), F.lit("")).alias("_na")]
    best = top_k_per_key(rows.select("*", *keys), ["_nt", "_np", "_na"], order, 1)
    return top_k(best.drop("_nt", "_np", "_na", "rank"), order, k)


def notable_drops(active: DataFrame, drops: DataFrame, entity: str, k: int = 8) -> DataFrame:
    """F11 > 0, largest drop first, dedup by (title, price, date)."""
    r = active.join(drops, entity, "inner").filter(F.col("drop_pct") > 0)
    return _notable(r, [F.col("drop_pct").desc()] + _tie(), k)


def notable_soon(active: DataFrame, as_of, k: int = 8) -> DataFrame:
    """0 <= days until auction <= 7, soonest first."""
    d = days_until("auction_text", as_of)
    r = active.withColumn("days", d).filter((F.col("days") >= 0) & (F.col("days") <= 7))
    return _notable(r, [F.col("days").asc()] + _tie(), k)


def notable_affordable(active: DataFrame, k: int = 8, below: int = 300_000) -> DataFrame:
    """0 < price < 300,000, cheapest first."""
    r = active.filter((F.col("price_value") > 0) & (F.col("price_value") < below))
    return _notable(r, [F.col("price_value").asc()] + _tie(), k)


def notable_landed(active: DataFrame, k: int = 8) -> DataFrame:
    """Type Landed, cheapest first."""
    r = active.filter(F.col("property_type") == "Landed")
    return _notable(r, [F.coalesce(F.col("price_value"), F.lit(0)).asc()] + _tie(), k)


def same_scheme(listings: DataFrame, entity: str, k: int = 10, scheme_col: str = "scheme_name") -> DataFrame:
    """For every listing with a scheme, up to k other non-expired listings with the same scheme, in
    arrival order, itself excluded. Bounded under skew: per scheme only the first k+1 candidates (a
    WindowGroupLimit) are joined back, so a scheme with n listings yields at most n * (k + 1) pairs.
    Returns (entity, rank, other)."""
    cand = listings.filter(~F.col("is_expired") & (F.coalesce(F.col(scheme_col), F.lit("")) != "")).select(
        F.col(scheme_col).alias("_scheme"), F.col(entity).alias("other"), F.col("arrival").alias("_oarr")
    )
    cand = top_k_per_key(cand, ["_scheme"], [F.col("_oarr").asc()], k + 1).drop("rank")
    src = listings.filter(F.coalesce(F.col(scheme_col), F.lit("")) != "").select(entity, F.col(scheme_col).alias("_scheme"))
    pairs = src.join(cand, "_scheme", "inner").filter(F.col(entity) != F.col("other"))
    ranked = top_k_per_key(pairs, [entity], [F.col("_oarr").asc()], k)
    return ranked.select(entity, "rank", "other")


def auctions_per_week(active: DataFrame, as_of, weeks: int = 8, day_col: str = "auction_day") -> DataFrame:
    """D16 + E6: counts of active listings per Monday week for ``weeks`` weeks starting with the ISO week of
    as_of (Q14), empty weeks kept, share of the largest week (at least 1) and a current-week flag.
    Each row gets its week index by arithmetic (an equi-key), the 8-row week spine is joined at the end."""
    from pyspark.sql import SparkSession

    spark: SparkSession = active.sparkSession
    start = F.date_trunc("week", F.lit(as_of).cast("timestamp")).cast("date")
    idx = F.floor(F.datediff(F.col(day_col), start) / 7).cast("int")
    counts = (active.filter(F.col(day_col).isNotNull()).select(idx.alias("week"))
              .filter((F.col("week") >= 0) & (F.col("week") < weeks))
              .groupBy("week").agg(F.count(F.lit(1)).alias("n")))
    spine = spark.range(weeks).select(F.col("id").cast("int").alias("week"))
    # the spine has `weeks` rows (a proven bound), so it is broadcast
    out = F.broadcast(spine).join(counts, "week", "left").select(
        "week",
        F.date_add(start, F.col("week") * 7).alias("week_start"),
        F.date_add(start, F.col("week") * 7 + 6).alias("week_end"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )
    mx = F.greatest(F.max("n").over(Window.partitionBy(F.lit(1))), F.lit(1))
    asof_day = F.to_date(F.lit(as_of))
    return out.select(
        "*",
        F.round(F.col("n") * 100.0 / mx, 0).alias("pct_of_max"),
        ((F.col("week_start") <= asof_day) & (asof_day <= F.col("week_end"))).alias("is_current_week"),
    )
