"""Per-entity history over ordered observations.

Observation order is (scan_date, obs_seq). Two building blocks keep hot entities from landing in one task:

* ``previous_values`` computes lag() in two levels: inside (entity, scan_date, sequence block) segments,
  then across the per-segment summaries of an entity. A hot entity is split by scan and by block; the second
  level has one row per segment. Told to count first, it takes one window per entity where none is hot.
* ``current_state`` uses ``max_by``/``min_by`` aggregates, which combine map-side (partial aggregation), so
  no group is ever collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import categorize_property_type, is_valid_price, price_value, stable_key, strip_weekday
from ..session import stored
from .asof import HOT_ROWS, hot_keys

ORDER = ("scan_date", "obs_seq")


def _order_key(scan_col: str = "scan_date", seq_col: str = "obs_seq"):
    return F.struct(F.col(scan_col).alias("s"), F.col(seq_col).alias("q"))


SEG_BITS = 33  # obs_seq >> 33 = the source partition of order_sequence's numbering


def previous_values(df: DataFrame, entity: str, value_cols, scan_col: str = "scan_date",
                    seq_col: str = "obs_seq", seg_bits: int = SEG_BITS, hot_rows: int | None = None) -> DataFrame:
    """Add ``prev_<c>`` (value of c on the entity's previous observation, null on its first) for each
    value column, and ``is_first`` (first observation of the entity). Values are compared as given, so
    callers coalesce nulls first when null and '' must be equal.

    The rows are cut into segments (:func:`_previous_by_segments`), so that a hot entity is in no one task. With ``hot_rows``
    the entities are counted first, and where none has more rows, one window per entity does it: the rows are shuffled once
    and stay partitioned by entity for what follows."""
    value_cols = list(value_cols)
    if hot_rows is None or hot_keys(df, entity, hot_rows):
        return _previous_by_segments(df, entity, value_cols, scan_col, seq_col, seg_bits)
    return _previous_by_entity(df, entity, value_cols, scan_col, seq_col)


def _previous_by_entity(df: DataFrame, entity: str, value_cols, scan_col: str = "scan_date", seq_col: str = "obs_seq") -> DataFrame:
    """:func:`previous_values` in one window per entity, where none is hot."""
    w = Window.partitionBy(entity).orderBy(scan_col, seq_col)
    return df.select("*", (F.row_number().over(w) == 1).alias("is_first"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in value_cols])


def _previous_by_segments(df: DataFrame, entity: str, value_cols, scan_col: str, seq_col: str, seg_bits: int) -> DataFrame:
    """:func:`previous_values` in two levels, for hot entities. Segments are (entity, scan_date, obs_seq >> seg_bits): a hot
    entity is split by scan and, inside a scan, by blocks of the sequence (with order_sequence's numbering, one block per
    source partition). The second level orders one summary row per segment."""
    rows = df.withColumn("_blk", F.shiftright(F.col(seq_col), seg_bits))
    w_seg = Window.partitionBy(entity, scan_col, "_blk").orderBy(seq_col)
    rows = rows.withColumn("_rn_seg", F.row_number().over(w_seg))
    for c in value_cols:
        rows = rows.withColumn(f"_lag_{c}", F.lag(c).over(w_seg))

    seg = rows.groupBy(entity, scan_col, "_blk").agg(
        *[F.max_by(c, seq_col).alias(f"_last_{c}") for c in value_cols]
    )
    w_ent = Window.partitionBy(entity).orderBy(scan_col, "_blk")
    seg = seg.select(
        entity, scan_col, "_blk",
        F.row_number().over(w_ent).alias("_seg_no"),
        *[F.lag(f"_last_{c}").over(w_ent).alias(f"_seg_prev_{c}") for c in value_cols],
    )
    out = rows.join(seg, [entity, scan_col, "_blk"], "inner")
    first_in_seg = F.col("_rn_seg") == 1
    out = out.withColumn("is_first", first_in_seg & (F.col("_seg_no") == 1))
    for c in value_cols:
        out = out.withColumn(
            f"prev_{c}", F.when(first_in_seg, F.col(f"_seg_prev_{c}")).otherwise(F.col(f"_lag_{c}"))
        )
    drop = ["_rn_seg", "_seg_no", "_blk"] + [f"_lag_{c}" for c in value_cols] + [f"_seg_prev_{c}" for c in value_cols]
    return out.drop(*drop)


def _event_date(scan_col: str = "scan_date"):
    # The reference dates every event by the observation's last_updated, else the scan date.
    return F.coalesce(F.col("last_updated"), F.date_format(F.col(scan_col), "yyyy-MM-dd"))


def price_points(obs: DataFrame, entity: str, numeric: bool = False) -> DataFrame:
    """one point for the first observation, then one whenever the raw price text differs from the
    previous observation's (null compared as ''). ``numeric=True`` compares price_value instead (Q15).
    Returns (entity, scan_date, obs_seq, price, date, url)."""
    val = F.coalesce(F.col("price_value").cast("string"), F.lit("")) if numeric else F.coalesce(F.col("price"), F.lit(""))
    base = obs.withColumn("_v", val)
    if "listing_url" not in base.columns:
        base = base.withColumn("listing_url", F.lit(None).cast("string"))
    p = previous_values(base, entity, ["_v"], hot_rows=HOT_ROWS)
    keep = F.col("is_first") | (F.col("_v") != F.col("prev__v"))
    return p.filter(keep).select(
        entity, "scan_date", "obs_seq",
        F.coalesce(F.col("price"), F.lit("")).alias("price"),
        _event_date().alias("date"),
        F.coalesce(F.col("listing_url"), F.lit("")).alias("url"),
    )


def auction_points(obs: DataFrame, entity: str) -> DataFrame:
    """auction-date points (first observation, then every change of the raw text)."""
    base = obs.withColumn("_v", F.coalesce(F.col("auction_date"), F.lit("")))
    p = previous_values(base, entity, ["_v"], hot_rows=HOT_ROWS)
    keep = F.col("is_first") | (F.col("_v") != F.col("prev__v"))
    return p.filter(keep).select(entity, "scan_date", "obs_seq", F.col("_v").alias("auction_date"), _event_date().alias("date"))


def change_points(obs: DataFrame, entity: str, together: bool = False):
    """F1 for both fields: (price points, auction-date points), same rows and columns as ``price_points`` and
    ``auction_points``, with one look for hot entities. ``together`` returns one table instead, of the rows that are a point of either, with
    ``price_changed`` and ``auction_date_changed``."""
    base = obs.withColumn("_vp", F.coalesce(F.col("price"), F.lit(""))).withColumn(
        "_va", F.coalesce(F.col("auction_date"), F.lit("")))
    if "listing_url" not in base.columns:
        base = base.withColumn("listing_url", F.lit(None).cast("string"))
    p = previous_values(base, entity, ["_vp", "_va"], hot_rows=HOT_ROWS)
    told = [F.col("is_first") | (F.col(v) != F.col(f"prev_{v}")) for v in ("_vp", "_va")]
    where = (entity, "scan_date", "obs_seq")
    price, auction, date, url = F.col("_vp").alias("price"), F.col("_va").alias("auction_date"), _event_date().alias("date"), F.coalesce(F.col("listing_url"), F.lit("")).alias("url")
    if together:
        return p.filter(told[0] | told[1]).select(*where, price, auction, date, url, told[0].alias("price_changed"), told[1].alias("auction_date_changed"))
    return p.filter(told[0]).select(*where, price, date, url), p.filter(told[1]).select(*where, auction, date)


CHANGE_KINDS = (
    ("price_change", "Auction Price", "price"),
    ("auction_date_change", "Auction Date", "auction_date"),
)


def detect_changes(obs: DataFrame, entity: str, scan_date=None, hot_rows: int | None = None) -> DataFrame:
    """change rows (type, field, old_value, new_value, change_date) where the raw price or auction date
    differs from the entity's previous observation (nulls as ''). ``scan_date`` scopes the output to one
    scan (the latest scan in the reference); all change rows of that scan are kept (Q17). ``hot_rows`` as in ``previous_values``.
    Returns (entity, scan_date, obs_seq, type, field, old_value, new_value, change_date)."""
    base = obs
    for _, _, c in CHANGE_KINDS:
        base = base.withColumn(f"_v_{c}", F.coalesce(F.col(c), F.lit("")))
    p = previous_values(base, entity, [f"_v_{c}" for _, _, c in CHANGE_KINDS], hot_rows=hot_rows)
    p = p.filter(~F.col("is_first"))
    if scan_date is not None:
        p = p.filter(F.col("scan_date") == F.to_date(F.lit(scan_date)))
    kinds = F.array(*[
        F.when(F.col(f"_v_{c}") != F.col(f"prev__v_{c}"),
               F.struct(F.lit(t).alias("type"), F.lit(fld).alias("field"),
                        F.col(f"prev__v_{c}").alias("old_value"), F.col(f"_v_{c}").alias("new_value")))
        for t, fld, c in CHANGE_KINDS
    ])
    ex = p.select(entity, "scan_date", "obs_seq", _event_date().alias("change_date"),
                  F.explode(F.array_compact(kinds)).alias("k"))
    return ex.select(entity, "scan_date", "obs_seq", "k.type", "k.field", "k.old_value", "k.new_value", "change_date")


STATE_FIELDS = (
    "title", "location", "size", "header_short", "header_full", "header", "listing_id", "price", "price_value",
    "auction_date", "discount", "last_updated", "listing_url", "url", "image_url", "property_type", "scheme_name",
)


def current_state(obs: DataFrame, entity: str, extra=()) -> DataFrame:
    """one row per entity. Every field is its last non-null value in observation order; ``first_seen``
    is the first observation's last_updated (else its scan date); ``stable_key`` is frozen at the first
    observation; plus first/last scan, observation count and last obs_seq. property_type, when absent, is
    derived from the title (B9)."""
    fields = [c for c in STATE_FIELDS if c in obs.columns] + list(extra)
    key = _order_key()
    o = obs.withColumn("_k", key).withColumn(
        "_sk", stable_key("title", "location", "size", "header_full")
    )
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_k"))).alias(c) for c in fields]
    aggs += [
        F.min_by(_event_date(), F.col("_k")).alias("first_seen"),
        F.min_by(F.col("_sk"), F.col("_k")).alias("stable_key"),
        F.min("scan_date").alias("first_scan"),
        F.max("scan_date").alias("last_scan"),
        F.count(F.lit(1)).alias("n_obs"),
        F.max("obs_seq").alias("last_obs_seq"),
        F.min("obs_seq").alias("first_obs_seq"),
    ]
    state = o.groupBy(entity).agg(*aggs)
    if "property_type" not in fields:
        state = state.withColumn("property_type", categorize_property_type("title"))
    return state


def state_and_points(obs: DataFrame, entity: str, extra=()) -> tuple[DataFrame, DataFrame]:
    """:func:`current_state` and :func:`change_points` (``together``, with each point's place ``price_pos`` / ``auction_date_pos`` among its
    entity's points, null where the field has none), stored.

    Where no entity is hot, both come from one window: the rows are shuffled and sorted by entity once. The aggregates of
    ``current_state`` would sort the rows before the shuffle too, with an order key for every field, though the rows of an entity seldom
    meet there."""
    points = ("scan_date", "obs_seq", "price", "auction_date", "date", "url")
    w = Window.partitionBy(entity).orderBy(*ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def places(df: DataFrame) -> list[Column]:
        return [F.when(F.col(f"{c}_changed"), F.sum(F.col(f"{c}_changed").cast("int")).over(so_far).cast("int")).alias(f"{c}_pos") for c in ("price", "auction_date")]

    if hot_keys(obs, entity, HOT_ROWS):
        told = change_points(obs, entity, together=True)
        return stored(current_state(obs, entity, extra), "state"), stored(told.select(entity, *points, *places(told)), "points")
    fields = [c for c in STATE_FIELDS if c in obs.columns] + list(extra)
    values = {"_vp": F.coalesce("price", F.lit("")), "_va": F.coalesce("auction_date", F.lit("")), "_date": _event_date()}
    if "listing_url" not in obs.columns:
        values["listing_url"] = F.lit(None).cast("string")
    # the values are made after the shuffle, which would else hold each text twice
    rows = obs.select(entity, *dict.fromkeys([*ORDER, *fields, "price", "auction_date", "last_updated", *(c for c in ("listing_url",) if c in obs.columns)])).repartition(entity)
    rows = _previous_by_entity(rows.withColumns(values), entity, ["_vp", "_va"])
    rows = rows.withColumns({f"{c}_changed": F.col("is_first") | (F.col(v) != F.col(f"prev_{v}")) for c, v in (("price", "_vp"), ("auction_date", "_va"))})
    key = ("title", "location", "size", "header_full")
    state = F.struct(
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in fields], F.first("_date").over(so_far).alias("first_seen"),
        *[F.first(c).over(so_far).alias(f"_first_{c}") for c in key], F.first("scan_date").over(so_far).alias("first_scan"), F.col("scan_date").alias("last_scan"),
        F.row_number().over(w).cast("long").alias("n_obs"), F.max("obs_seq").over(so_far).alias("last_obs_seq"), F.min("obs_seq").over(so_far).alias("first_obs_seq"))
    is_last = F.lead("obs_seq").over(w).isNull()
    rows = rows.select(entity, "scan_date", "obs_seq", F.col("_vp").alias("price"), F.col("_va").alias("auction_date"), F.col("_date").alias("date"),
                       F.coalesce("listing_url", F.lit("")).alias("url"), *places(rows), F.when(is_last, state).alias("state"))
    rows = stored(rows.where("price_pos is not null or auction_date_pos is not null or state is not null"), "history")
    last = rows.where("state is not null").select(entity, "state.*")
    out = last.select(entity, *fields, "first_seen", stable_key(*[f"_first_{c}" for c in key]).alias("stable_key"), "first_scan", "last_scan", "n_obs", "last_obs_seq", "first_obs_seq")
    if "property_type" not in fields:
        out = out.withColumn("property_type", categorize_property_type("title"))
    return out, rows.select(entity, *points, "price_pos", "auction_date_pos").where("price_pos is not null or auction_date_pos is not null")


# --------------------------------------------------------------------------------------------------------
# Publish-side history (F8-F13). Inputs are the long point tables of F1 (few rows per entity: one per change),
# so the per-entity windows below run over change points or days, never over raw observations.



def recent_prices(points: DataFrame, entity: str, listing_url: DataFrame | None = None, k: int = 5) -> DataFrame:
    """the last k price points whose price is valid (B13), with day = first 10 chars of the date and
    url falling back to the listing url. ``points`` = F1 price points (entity, scan_date, obs_seq, price,
    date, url); ``listing_url`` optional (entity, listing_url). Returns (entity, pos, price, day, url, n_valid)
    with pos 1..k in time order."""
    p = points.filter(is_valid_price("price"))
    if listing_url is not None:
        p = p.join(listing_url, entity, "left")
        url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("listing_url"), F.lit(""))
    else:
        url = F.coalesce(F.col("url"), F.lit(""))
    p = p.select(entity, "scan_date", "obs_seq", "price", F.substring("date", 1, 10).alias("day"), url.alias("url"))
    w_desc = Window.partitionBy(entity).orderBy(F.desc("scan_date"), F.desc("obs_seq"))
    p = p.withColumn("_rd", F.row_number().over(w_desc)).filter(F.col("_rd") <= k)
    w_cnt = Window.partitionBy(entity)
    p = p.withColumn("n_kept", F.count(F.lit(1)).over(w_cnt))
    return p.select(entity, (F.col("n_kept") - F.col("_rd") + 1).alias("pos"), "price", "day", "url", "n_kept")


def price_drop_pct(recent: DataFrame, entity: str) -> DataFrame:
    """over F9's points: (first - last) / first * 100 when last < first and both > 0; fewer than two
    points -> 0. Returns (entity, drop_pct)."""
    agg = recent.groupBy(entity).agg(
        F.min_by(price_value("price"), "pos").alias("_first"),
        F.max_by(price_value("price"), "pos").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    drop = F.when(
        (F.col("_n") >= 2) & (F.col("_first") > 0) & (F.col("_last") > 0) & (F.col("_last") < F.col("_first")),
        (F.col("_first") - F.col("_last")) * 100.0 / F.col("_first"),
    ).otherwise(F.lit(0.0))
    return agg.select(entity, drop.alias("drop_pct"))


def history_rounds(price_pts: DataFrame, auction_pts: DataFrame, entity: str,
                   listing_url: DataFrame | None = None, keep: int = 10) -> DataFrame:
    """F8: merge price and auction-date points by day (last event of a day wins per field; a day's url is
    the last price point's url, else the listing url), carry price and date forward, drop rounds equal to
    the previous one in both, keep the last ``keep``; nothing when at most one round remains.
    Returns (entity, pos, day, price, auction_date, url) with pos 1..n in day order."""
    lu = listing_url
    pp = price_pts.select(
        entity, F.substring("date", 1, 10).alias("day"), F.struct("scan_date", "obs_seq").alias("_k"),
        F.when(is_valid_price("price"), F.col("price")).alias("p"),
        F.nullif(F.col("url"), F.lit("")).alias("u"),
    ).filter(F.col("day") != "")
    ap = auction_pts.select(
        entity, F.substring("date", 1, 10).alias("day"), F.struct("scan_date", "obs_seq").alias("_k"),
        F.nullif(strip_weekday("auction_date"), F.lit("")).alias("ad"),
    ).filter(F.col("day") != "")
    # one aggregate over both kinds of points: rows that are partitioned by entity already are not shuffled for it
    both = pp.withColumn("has_price_event", F.lit(True)).unionByName(ap, allowMissingColumns=True)
    days = both.groupBy(entity, "day").agg(
        F.max_by("p", F.when(F.col("p").isNotNull(), F.col("_k"))).alias("p"),
        F.max_by("u", F.when(F.col("has_price_event"), F.col("_k"))).alias("pu"),
        F.max("has_price_event").alias("has_price_event"),
        F.max_by("ad", F.when(F.col("ad").isNotNull(), F.col("_k"))).alias("ad"),
    )
    if lu is not None:
        days = days.join(lu, entity, "left")
        fallback = F.nullif(F.col("listing_url"), F.lit(""))
    else:
        fallback = F.lit(None).cast("string")
    # Price events set the url to their own url or the listing url; auction-only days get the listing url.
    days = days.withColumn("u", F.when(F.col("has_price_event"), F.coalesce(F.col("pu"), fallback)).otherwise(fallback))
    w = Window.partitionBy(entity).orderBy("day")
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.select(
        entity, "day", "u",
        F.last("p", ignorenulls=True).over(w_run).alias("price"),
        F.last("ad", ignorenulls=True).over(w_run).alias("auction_date"),
    )
    prev_p = F.lag("price").over(w)
    prev_a = F.lag("auction_date").over(w)
    days = days.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_same", (F.col("_rn") > 1) & F.equal_null(F.col("price"), prev_p) & F.equal_null(F.col("auction_date"), prev_a)
    )
    kept = days.filter(~F.col("_same"))
    w_desc = Window.partitionBy(entity).orderBy(F.desc("day"))
    kept = kept.withColumn("_rd", F.row_number().over(w_desc)).filter(F.col("_rd") <= keep)
    kept = kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(entity))).filter(F.col("_n") > 1)
    return kept.select(entity, (F.col("_n") - F.col("_rd") + 1).alias("pos"), "day", "price", "auction_date",
                       F.col("u").alias("url"))


def round_changes(rounds: DataFrame, entity: str) -> DataFrame:
    """per history round, whether price / auction date differ from the previous round."""
    w = Window.partitionBy(entity).orderBy("pos")
    return rounds.select(
        "*",
        (F.col("pos") > 1) & ~F.equal_null(F.col("price"), F.lag("price").over(w)),
        (F.col("pos") > 1) & ~F.equal_null(F.col("auction_date"), F.lag("auction_date").over(w)),
    ).toDF(*rounds.columns, "price_changed", "date_changed")


def price_series(recent: DataFrame, entity: str) -> DataFrame:
    """per listing the min-max scaled series of F9's positive prices (range 0 -> 1) and the direction
    (last <= first -> 'down'). Needs two or more positive values. Returns (entity, pos, price_value, scaled,
    direction)."""
    v = recent.select(entity, "pos", price_value("price").alias("price_value")).filter(F.col("price_value") > 0)
    w = Window.partitionBy(entity)
    v = v.select(
        "*",
        F.min("price_value").over(w).alias("_mn"), F.max("price_value").over(w).alias("_mx"),
        F.count(F.lit(1)).over(w).alias("_n"),
        F.first("price_value").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"),
        F.last("price_value").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"),
    ).filter(F.col("_n") >= 2)
    rng = F.when(F.col("_mx") - F.col("_mn") == 0, F.lit(1)).otherwise(F.col("_mx") - F.col("_mn"))
    return v.select(
        entity, "pos", "price_value",
        F.round((F.col("price_value") - F.col("_mn")) / rng, 6).alias("scaled"),
        F.when(F.col("_last") <= F.col("_first"), F.lit("down")).otherwise(F.lit("up")).alias("direction"),
    )


def merge_histories(member_points: DataFrame, group: str, value_col: str, small_groups: bool = False) -> DataFrame:
    """union of the members' points (value, date) of one group, distinct on (value, date), sorted by date
    (ties: first arrival), consecutive repeats of the value dropped. ``member_points`` has (group, value,
    date, arrival) where arrival orders the members' points as the reference visits them.
    ``small_groups`` says that no group has very many points: the rows are then shuffled once, by group, and else by the
    distinct points first, so that the copies of a hot group are gone before its rows meet. Returns (group, pos, value, date)."""
    if small_groups:
        member_points = member_points.repartition(group)
    first = member_points.groupBy(group, value_col, "date").agg(F.min("arrival").alias("arrival"))
    w = Window.partitionBy(group).orderBy("date", "arrival")
    ranked = first.withColumn("_prev", F.lag(value_col).over(w)).withColumn("_rn", F.row_number().over(w))
    kept = ranked.filter((F.col("_rn") == 1) | ~F.equal_null(F.col(value_col), F.col("_prev")))
    return kept.select(group, F.row_number().over(w).alias("pos"), value_col, "date")
