"""Rebuild: per-scan logs, last-scan stats, KPI row and digest from labelled observations (A4, A5, A7, E3,
E5, E10, D10, D11, G10, B29).

Everything is kept in long form (one row per scan, per new entity, per change). Arrays are only built for a
single scan's export, never across the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alert_card
from ..operators.asof import HOT_ROWS
from ..operators.history import detect_changes
from ..session import stored


def scan_new_entities(obs: DataFrame, entity: str) -> DataFrame:
    """(scan_date, entity, arrival): entities whose first observation is in that scan."""
    return obs.groupBy(entity).agg(
        F.min("scan_date").alias("scan_date"), F.min("obs_seq").alias("arrival")
    )


def scan_log(obs: DataFrame, entity: str) -> DataFrame:
    """A4: one row per scan: new_listings_count, changed_properties_count (entities with at least one change
    in the scan), change_count, listings_seen. All aggregates; no per-scan arrays."""
    seen = obs.groupBy("scan_date").agg(F.count(F.lit(1)).alias("listings_seen"))
    new = scan_new_entities(obs, entity).groupBy("scan_date").agg(F.count(F.lit(1)).alias("new_listings_count"))
    ch = detect_changes(obs, entity, hot_rows=HOT_ROWS).groupBy("scan_date").agg(
        F.countDistinct(entity).alias("changed_properties_count"), F.count(F.lit(1)).alias("change_count")
    )
    out = seen.join(new, "scan_date", "left").join(ch, "scan_date", "left")
    return out.select(
        "scan_date",
        F.coalesce("new_listings_count", F.lit(0)).cast("bigint").alias("new_listings_count"),
        F.coalesce("changed_properties_count", F.lit(0)).cast("bigint").alias("changed_properties_count"),
        F.coalesce("change_count", F.lit(0)).cast("bigint").alias("change_count"),
        F.col("listings_seen").cast("bigint"),
    )


def change_summary(obs: DataFrame, entity: str) -> DataFrame:
    """Changes per scan and type."""
    return detect_changes(obs, entity, hot_rows=HOT_ROWS).groupBy("scan_date", "type").agg(F.count(F.lit(1)).alias("n"))


def scan_history(log: DataFrame, k: int = 15) -> DataFrame:
    """E5: the last k scans, newest first: (rank, d, n, c). The log has one row per scan (small)."""
    top = log.orderBy(F.desc("scan_date")).limit(k)
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("scan_date"))).cast("bigint").alias("rank"),
        F.col("scan_date").alias("d"), F.col("new_listings_count").alias("n"), F.col("changed_properties_count").alias("c"),
    )


def latest_scan_date(obs: DataFrame):
    return obs.agg(F.max("scan_date").alias("d")).first()["d"]


def scan_records(obs: DataFrame, state: DataFrame, entity: str) -> DataFrame:
    """A4, the contents of the log: one row per new entity and per change record of every scan, each with the
    entity's current title. Long form: a scan with very many changes is many rows, not one array."""
    none = F.lit(None).cast("string")
    new = scan_new_entities(obs, entity).select("scan_date", F.lit("new").alias("kind"), entity, *(none.alias(c) for c in ("type", "field", "old_value", "new_value", "change_date")))
    ch = detect_changes(obs, entity, hot_rows=HOT_ROWS).select("scan_date", F.lit("change").alias("kind"), entity, "type", "field", "old_value", "new_value", F.col("change_date").cast("string").alias("change_date"))
    return new.unionByName(ch).join(state.select(entity, "title"), entity, "left")


def scan_stats(obs: DataFrame, entity: str, scan) -> DataFrame:
    """A5: counters of one scan: listings in the scan, entities tracked up to it, new, changed."""
    upto = obs.filter(F.col("scan_date") <= F.lit(scan))
    log = scan_log(upto, entity).filter(F.col("scan_date") == F.lit(scan))
    tracked = upto.agg(F.countDistinct(entity).alias("n")).first()["n"]
    return log.select(
        F.col("scan_date").alias("date"), F.col("listings_seen").alias("total_listings"),
        F.lit(tracked).cast("bigint").alias("total_tracked"),
        F.col("new_listings_count").alias("new_listings"), F.col("changed_properties_count").alias("changed_properties"),
    )


def latest_changes(obs: DataFrame, entity: str, scan) -> DataFrame:
    """The last scan's new entity ids and change records as long rows (kind, entity, fields)."""
    new = scan_new_entities(obs, entity).filter(F.col("scan_date") == F.lit(scan)).select(
        F.lit("new").alias("kind"), F.col(entity), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"),
        F.lit(None).cast("string").alias("change_date"),
    )
    ch = detect_changes(obs.filter(F.col("scan_date") <= F.lit(scan)), entity, scan_date=scan, hot_rows=HOT_ROWS).select(
        F.lit("change").alias("kind"), F.col(entity), "type", "old_value", "new_value", "change_date"
    )
    return new.unionByName(ch)


def kpi_stats(published: DataFrame, log: DataFrame, drops: DataFrame, entity: str) -> DataFrame:
    """Tracked, active (C1), new and changed of the last scan, truncated average price over active
    listings with price_value > 0, discounted_count (active with discount text: the reference's "drop" KPI,
    Q12), price_drop_count (active with F11 > 0), last and previous scan dates (previous only with >= 2 scans)."""
    pub = published.join(drops, entity, "left")
    act = F.col("is_active")
    kp = pub.agg(
        F.count(F.lit(1)).alias("total_tracked"),
        F.count(F.when(act, 1)).alias("active_count"),
        F.coalesce(F.floor(F.avg(F.when(act & (F.col("price_value") > 0), F.col("price_value")))), F.lit(0)).cast("bigint").alias("avg_price"),
        F.count(F.when(act & (F.col("discount") != ""), 1)).alias("discounted_count"),
        F.count(F.when(act & (F.coalesce(F.col("drop_pct"), F.lit(0.0)) > 0), 1)).alias("price_drop_count"),
    )
    last2 = log.orderBy(F.desc("scan_date")).limit(2).collect()  # at most two log rows
    last = last2[0] if last2 else None
    prev = last2[1] if len(last2) > 1 else None
    return kp.select(
        "*",
        F.lit(last["new_listings_count"] if last else 0).cast("bigint").alias("new_count"),
        F.lit(last["changed_properties_count"] if last else 0).cast("bigint").alias("changed_count"),
        F.lit(last["scan_date"] if last else None).cast("date").alias("scan_date"),
        F.lit(prev["scan_date"] if prev else None).cast("date").alias("prev_scan_date"),
    )


def new_listing_details(obs: DataFrame, published: DataFrame, entity: str, scan, k: int = 20) -> DataFrame:
    """The last scan's new ids in arrival order, first k, joined to the listings (missing dropped)."""
    new = scan_new_entities(obs, entity).filter(F.col("scan_date") == F.lit(scan))
    first = new.orderBy("arrival").limit(k)
    joined = first.join(published.drop("arrival"), entity, "inner")
    return joined.select(F.row_number().over(Window.orderBy("arrival")).cast("bigint").alias("rank"), entity, "title", "price", "auction_text")


def changes_by_property(obs: DataFrame, published: DataFrame, entity: str, scan) -> DataFrame:
    """The last scan's change records grouped per property (count, sorted distinct types), kept only
    for properties that still exist in the published table."""
    ch = detect_changes(obs.filter(F.col("scan_date") <= F.lit(scan)), entity, scan_date=scan, hot_rows=HOT_ROWS)
    g = ch.groupBy(entity).agg(F.count(F.lit(1)).alias("n_changes"), F.sort_array(F.collect_set("type")).alias("types"))
    return g.join(published.select(entity), entity, "left_semi")


def scan_digest(obs: DataFrame, state: DataFrame, entity: str, scan, k: int = 5) -> DataFrame:
    """The first k new and the first k changed entities of a scan, in arrival order, as alert cards
    (B29), plus one count row per section ('+N more' when above k). ``state`` is the table of current states, or a function that returns
    that of a list of entities: it is then asked for those shown only. Rows: (section, rank, entity, text)."""
    new = scan_new_entities(obs, entity).filter(F.col("scan_date") == F.lit(scan))
    ch = detect_changes(obs.filter(F.col("scan_date") <= F.lit(scan)), entity, scan_date=scan, hot_rows=HOT_ROWS)
    # the card shows the change list of the entity's last changed observation in the scan (as the reference
    # keeps only the last list), positioned by the entity's first change
    last = ch.groupBy(entity).agg(F.min("obs_seq").alias("arrival"), F.max("obs_seq").alias("_last"))
    lc = ch.join(last, entity).filter(F.col("obs_seq") == F.col("_last"))
    per = lc.groupBy(entity, "arrival").agg(
        F.max(F.when(F.col("type") == "price_change", F.col("old_value"))).alias("old_price"),
        F.max(F.when(F.col("type") == "price_change", F.col("new_value"))).alias("new_price"),
        F.max(F.when(F.col("type") == "auction_date_change", F.col("old_value"))).alias("old_date"),
        F.max(F.when(F.col("type") == "auction_date_change", F.col("new_value"))).alias("new_date"),
    )
    new, per = stored(new, "new"), stored(per, "changed")  # counted and shown
    n_new, n_changed = new.count(), per.count()
    if callable(state):
        shown = {r[0] for x in (new, per) for r in x.orderBy("arrival").limit(k).select(entity).collect()}
        state = state(sorted(shown))
    st = state.select(entity, "title", "location", "header_full", "property_type", "size", "discount", "price",
                      "auction_date", F.coalesce(*[F.col(c) for c in ("listing_url",) if c in state.columns], F.lit(None).cast("string")).alias("url"))
    w = Window.orderBy("arrival")
    new_top = new.orderBy("arrival").limit(k).withColumn("rank", F.row_number().over(w)).join(st, entity, "inner")
    new_cards = new_top.select(
        F.lit("new").alias("section"), "rank", entity,
        alert_card("rank", "title", "location", "header_full", "property_type", "size", "discount", "price",
                   "auction_date", "url").alias("text"),
    )
    ch_top = per.orderBy("arrival").limit(k).withColumn("rank", F.row_number().over(w)).join(st, entity, "inner")
    ch_cards = ch_top.select(
        F.lit("changed").alias("section"), "rank", entity,
        alert_card("rank", "title", "location", "header_full", "property_type", "size", "discount", "price",
                   "auction_date", "url", "old_price", "new_price", "old_date", "new_date").alias("text"),
    )
    spark = obs.sparkSession
    counts = spark.createDataFrame(
        [("new_count", 0, None, f"NEW ({n_new})" + (f" +{n_new - k} more" if n_new > k else "")),
         ("changed_count", 0, None, f"CHANGES ({n_changed})" + (f" +{n_changed - k} more" if n_changed > k else ""))],
        f"section string, rank int, {entity} bigint, text string",
    )
    return new_cards.unionByName(ch_cards).unionByName(counts)


def rebuild_entities(obs: DataFrame) -> dict:
    """The rebuild of one history: observations -> entities (D4) -> current state (F4) -> change rows (F2)
    -> scan log (A4), all keyed by the resolved ``entity_id``. Returns the four DataFrames by name."""
    from ..operators.resolve import resolve_entities
    from ..session import cut_lineage

    return rebuilt(cut_lineage(resolve_entities(obs)))  # read by every later step


def told_rows(labelled: DataFrame) -> DataFrame:
    """What changes and the log read of labelled observations, stored."""
    return stored(labelled.select("entity_id", "scan_date", "obs_seq", "price", "auction_date", "last_updated"), "told")


def rebuilt(labelled: DataFrame) -> dict:
    """:func:`rebuild_entities` for observations that have their ``entity_id``. What the changes and the log read is stored once, so
    that neither takes the other texts along."""
    from ..operators.history import current_state

    told = told_rows(labelled)
    return {
        "labelled": labelled,
        "state": current_state(labelled, "entity_id"),
        "changes": detect_changes(told, "entity_id", hot_rows=HOT_ROWS),
        "log": scan_log(told, "entity_id"),
    }
