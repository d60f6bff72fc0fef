"""Entity grouping of a property database (F14 with C14, D14, D15, F5, F6, F7, E7, E8, H1).

Input: ``entries`` (one row per database entry: entry_id, arrival, listing fields, first_seen, last_updated)
and the entries' price / auction-date points. Phases:

0. drop junk entries (C14);
1. entries with a listing id group by (listing id, normalised size);
2. entries without id join the id-groups' key tables on (address, size), or on address alone when they have
   no size (D14). Key tables are built by aggregates whose order encodes "last wins";
3. the rest group by the dedup stable key;
4. key-groups whose best entry's (title, size) equals an id-group best entry's move over as a whole (D15,
   "first wins" in id-group order);
5. per final group: best entry (F6), merged histories (F5), first/last bounds (E7), unique slug (F7), new
   stable key and scheme. Id-groups are listed first, then key-groups (H1).

Every index is a groupBy aggregate and every cross-match a left join to a table with one row per key, so no
join fans out and no group is collected into one task. Histories are merged as long tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm_address, norm_size, norm_text, parse_any_date, property_slug, scheme_from_header
from ..operators.asof import HOT_ROWS, hot_keys, last_before
from ..operators.history import merge_histories
from ..operators.predicates import is_expired, is_junk
from ..operators.rank import first_per_key
from ..operators.sequence import dense_index
from ..session import cut_lineage

PLACEHOLDER = "Property Listing"
SIZE_SENTINEL = "Size not specified"


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def pick_best_score(canonical_prefix: str | None = None) -> Column:
    """F6 score: 100 listing id, 50 address, 40 canonical listing URL (when a prefix is given), 20 real size,
    10 image, 10 short header, 30 real title."""
    s = (F.when(~_blank("listing_id"), 100).otherwise(0)
         + F.when(~_blank("header_full") | ~_blank("header"), 50).otherwise(0)
         + F.when(~_blank("size") & (F.col("size") != SIZE_SENTINEL), 20).otherwise(0)
         + F.when(~_blank("image_url"), 10).otherwise(0)
         + F.when(~_blank("header_short"), 10).otherwise(0)
         + F.when(~_blank("title") & ~F.coalesce(F.col("title"), F.lit("")).startswith(PLACEHOLDER), 30).otherwise(0))
    if canonical_prefix:
        s = s + F.when(F.coalesce(F.col("listing_url"), F.lit("")).startswith(canonical_prefix), 40).otherwise(0)
    return s


OPTIONAL = ("header", "image_url", "listing_url", "header_short", "scheme_name")


def _prepare(entries: DataFrame) -> DataFrame:
    for c in OPTIONAL:
        if c not in entries.columns:
            entries = entries.withColumn(c, F.lit(None).cast("string"))
    addr = norm_address(F.coalesce(F.nullif(F.col("header"), F.lit("")), F.nullif(F.col("header_full"), F.lit("")), F.lit("")))
    return entries.select(
        "*", addr.alias("_addr"), norm_size("size").alias("_nsize"), norm_text("title").alias("_ntitle"),
        is_junk(entries.columns).alias("_junk"),
    )


def assign_groups(entries: DataFrame, canonical_prefix: str | None = None) -> DataFrame:
    """Phases 0-4. Returns the non-junk entries with ``group_id``, ``group_kind`` ('id' / 'key'),
    ``group_order`` (output order of the group), ``member_order`` (order inside the group) and ``phase``
    (1, 2, 3 or 4: how the entry joined its group)."""
    # the prepared entries feed every phase: materialise once in the shared checkpoint folder. The phases see the keys of the entries
    # only and keep what several later steps read; the fields come back by entry_id at the end
    e = cut_lineage(_prepare(entries).withColumn("_score", pick_best_score(canonical_prefix)))
    fields = e.filter(~F.col("_junk"))
    clean = fields.select("entry_id", "arrival", "listing_id", norm_text("location").alias("_nloc"), "_addr", "_nsize", "_ntitle", "_score")

    # phase 1: id-groups, ordered by their first entry
    lid = clean.filter(~_blank("listing_id")).withColumn("_gk", F.concat(F.col("listing_id"), F.lit("|"), F.col("_nsize")))
    lid = cut_lineage(lid.join(lid.groupBy("_gk").agg(F.min("arrival").alias("_g_arr")), "_gk").drop("listing_id", "_nloc"))
    g_order = lid.groupBy("_gk").agg(F.min("_g_arr").alias("_g_arr"))
    nolid = clean.filter(_blank("listing_id")).drop("listing_id")

    # phase 2 indexes: (address, size) -> group and address -> group; the last entry visited (groups in
    # order, entries in order) wins
    visit = F.struct(F.col("_g_arr"), F.col("arrival"))
    as_idx = (lid.filter((F.length("_addr") > 20) & (F.col("_nsize") != ""))
              .groupBy(F.col("_addr").alias("_ia"), F.col("_nsize").alias("_is"))
              .agg(F.max_by("_gk", visit).alias("_gk_as")))
    a_idx = (lid.filter(F.length("_addr") > 20).groupBy(F.col("_addr").alias("_ja"))
             .agg(F.max_by("_gk", visit).alias("_gk_a")))
    n2 = nolid.join(as_idx, (F.col("_addr") == F.col("_ia")) & (F.col("_nsize") == F.col("_is")) & (F.col("_addr") != "")
                    & (F.col("_nsize") != ""), "left")
    n2 = n2.join(a_idx, (F.col("_addr") == F.col("_ja")) & (F.col("_addr") != "") & (F.col("_nsize") == ""), "left")
    n2 = cut_lineage(n2.withColumn("_gk", F.coalesce("_gk_as", "_gk_a")).drop("_ia", "_is", "_ja", "_gk_as", "_gk_a"))
    cross = n2.filter(F.col("_gk").isNotNull()).drop("_nloc").join(g_order, "_gk")
    rest = n2.filter(F.col("_gk").isNull()).drop("_gk")

    # phase 3: key-groups by the dedup stable key, ordered by their first entry
    sk = F.concat_ws("|", F.col("_ntitle"), F.col("_nloc"), F.col("_nsize"), F.col("_addr"))
    rest = rest.select("entry_id", "arrival", "_ntitle", "_nsize", "_score", sk.alias("_sk"))
    sk_order = rest.groupBy("_sk").agg(F.min("arrival").alias("_s_arr"))
    rest = cut_lineage(rest.join(sk_order, "_sk"))

    # phase 4: best entry per id-group (phases 1+2) -> (title, size) -> first id-group in group order
    members12 = lid.withColumn("phase", F.lit(1)).unionByName(cross.withColumn("phase", F.lit(2)))
    members12 = members12.select("entry_id", "_gk", "_g_arr", "phase", "_ntitle", "_nsize", "_score", F.struct(F.col("phase"), F.lit(0).cast("long").alias("s"), F.col("arrival")).alias("_m_ord"))
    best_lid = first_per_key(members12.drop("entry_id", "phase"), ["_gk"], [-F.col("_score"), F.col("_m_ord")])
    lts = (best_lid.filter((F.col("_ntitle") != "") & ~F.col("_ntitle").startswith("property listing") & (F.col("_nsize") != ""))
           .groupBy(F.col("_ntitle").alias("_lt"), F.col("_nsize").alias("_ls"))
           .agg(F.min_by("_gk", "_g_arr").alias("_gk4")))
    best_sk = first_per_key(rest.drop("entry_id", "_s_arr"), ["_sk"], [-F.col("_score"), F.col("arrival")]).select("_sk", "_ntitle", "_nsize")
    sk_to_lid = best_sk.join(lts, (F.col("_ntitle") == F.col("_lt")) & (F.col("_nsize") == F.col("_ls")), "inner").select("_sk", "_gk4")
    rest = cut_lineage(rest.drop("_ntitle", "_nsize", "_score").join(sk_to_lid, "_sk", "left"))
    moved = rest.filter(F.col("_gk4").isNotNull()).withColumn("_gk", F.col("_gk4")).join(g_order, "_gk")
    moved = moved.withColumn("phase", F.lit(4)).withColumn(
        "_m_ord", F.struct(F.col("phase"), F.col("_s_arr").cast("long").alias("s"), F.col("arrival")))
    keyg = rest.filter(F.col("_gk4").isNull())

    told = ["entry_id", "phase", "_m_ord", "_gk", "_g_arr"]
    idg = members12.select(*told).unionByName(moved.select(*told)).select(
        "entry_id", "phase", F.col("_m_ord").alias("member_order"), F.concat(F.lit("id:"), F.col("_gk")).alias("group_id"), F.lit("id").alias("group_kind"),
        F.struct(F.lit(0).alias("k"), F.col("_g_arr").alias("o")).alias("group_order"),
    )
    kg = keyg.select(
        "entry_id", F.lit(3).alias("phase"),
        F.struct(F.lit(3).alias("phase"), F.lit(0).cast("long").alias("s"), F.col("arrival").alias("arrival")).alias("member_order"),
        F.concat(F.lit("key:"), F.col("_sk")).alias("group_id"), F.lit("key").alias("group_kind"),
        F.struct(F.lit(1).alias("k"), F.col("_s_arr").alias("o")).alias("group_order"),
    )
    return fields.join(idg.unionByName(kg), "entry_id")


def group_entities(entries: DataFrame, price_pts: DataFrame, auction_pts: DataFrame, as_of,
                   canonical_prefix: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Phase 5. Returns (groups, members, merged price history, merged auction history).

    groups: one row per final group with the best entry's fields, first_seen / last_updated bounds, slug
    (unique, F7), stable key (header_full before header), scheme from the short header, is_expired.
    ``price_pts`` / ``auction_pts`` are (entry_id, pos, price|auction_date, date[, url])."""
    members = cut_lineage(assign_groups(entries, canonical_prefix))
    fields = ("title", "location", "size", "header_short", "header_full", "header", "listing_id", "price", "price_value", "auction_date", "discount")
    best = first_per_key(members.select("group_id", "group_kind", "group_order", "member_order", "entry_id", "_score", *fields), ["group_id"], [-F.col("_score"), F.col("member_order")])
    bounds = members.groupBy("group_id").agg(
        F.min(F.coalesce(F.nullif(F.col("first_seen"), F.lit("")), F.nullif(F.col("last_updated"), F.lit("")), F.lit(""))).alias("g_first_seen"),
        F.max(F.coalesce(F.nullif(F.col("last_updated"), F.lit("")), F.nullif(F.col("first_seen"), F.lit("")), F.lit(""))).alias("g_last_updated"),
        F.count(F.lit(1)).alias("n_members"),
    )
    g = best.join(bounds, "group_id")
    slug = property_slug("title", "location", "size", None, 120)
    addr_sk = norm_address(F.coalesce(F.nullif(F.col("header_full"), F.lit("")), F.nullif(F.col("header"), F.lit("")), F.lit("")))
    g = g.select(
        "group_id", "group_kind", "group_order", F.col("entry_id").alias("best_entry"), "n_members",
        "title", "location", "size", "header_short", "header_full", "listing_id", "price", "price_value", "auction_date",
        "discount", F.col("g_first_seen").alias("first_seen"), F.col("g_last_updated").alias("last_updated"),
        slug.alias("_slug"),
        F.concat_ws("|", norm_text("title"), norm_text("location"), norm_size("size"), addr_sk).alias("stable_key"),
        scheme_from_header("header_short").alias("scheme_name"),
        is_expired(as_of).alias("is_expired"),
        # the dedup's own notion of active: its date parser (short or full month names, ISO) on or after as_of
        F.coalesce(parse_any_date("auction_date") >= F.to_date(F.lit(as_of)), F.lit(False)).alias("is_active_dedup"),
    )
    g = unique_slug(cut_lineage(g))  # read for the ranks, the slugs and their rivals

    # member points + each member's current value dated last_updated (else first_seen)
    m = members.select("entry_id", "group_id", "member_order", "price", "auction_date", "listing_url",
                       F.coalesce(F.nullif(F.col("last_updated"), F.lit("")), F.col("first_seen")).alias("_cur_date"))
    pp = price_pts.join(m.select("entry_id", "group_id", "member_order"), "entry_id").select(
        "group_id", F.col("price"), F.col("date"), F.struct("member_order", F.col("pos").cast("long").alias("p")).alias("arrival"))
    cur_p = m.filter(~_blank("price")).select(
        "group_id", "price", F.col("_cur_date").alias("date"), F.struct("member_order", F.lit(1 << 40).cast("long").alias("p")).alias("arrival"))
    ap = auction_pts.join(m.select("entry_id", "group_id", "member_order"), "entry_id").select(
        "group_id", F.col("auction_date"), F.col("date"), F.struct("member_order", F.col("pos").cast("long").alias("p")).alias("arrival"))
    cur_a = m.filter(~_blank("auction_date")).select(
        "group_id", "auction_date", F.col("_cur_date").alias("date"), F.struct("member_order", F.lit(1 << 40).cast("long").alias("p")).alias("arrival"))
    # an entry has a point per observation at most, and its current value
    small = "n_obs" in members.columns and not members.groupBy("group_id").agg(F.sum(F.col("n_obs") + 1).alias("n")).where(F.col("n") > HOT_ROWS).limit(1).count()
    ph = merge_histories(pp.unionByName(cur_p).withColumn("date", F.coalesce("date", F.lit(""))), "group_id", "price", small)
    ah = merge_histories(ap.unionByName(cur_a).withColumn("date", F.coalesce("date", F.lit(""))), "group_id", "auction_date", small)
    return g, members, ph, ah


def rank_within(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """1-based rank of every row inside its ``key`` in ``order`` (a total order), without a per-key window:
    a distributed numbering over (key, order) minus the first number of the key. A key holding a third of
    the rows is spread over several range partitions."""
    idx = dense_index(df, [key] + list(order), "_gidx")
    base = idx.groupBy(key).agg(F.min("_gidx").alias("_kmin"))
    return idx.join(base, key).withColumn(name, F.col("_gidx") - F.col("_kmin") + 1).drop("_gidx", "_kmin")


#: A slug that reads as another slug's second, third, ... name.
NUMBERED = r"^(.+)_([2-9]|[1-9][0-9]{1,17})$"


def _rivals(groups: DataFrame, slug_col: str) -> DataFrame:
    """Slugs that are also a numbered name of another slug: ``(owner, k, slug, free)``. ``owner`` is the other slug and ``k`` the number;
    up to ``free`` groups of the owner come before the first group of the slug and so can have the name before it."""
    firsts = groups.groupBy(F.col(slug_col).alias("slug")).agg(F.min("group_order").alias("_o"))
    split = firsts.select("slug", "_o", F.regexp_extract("slug", NUMBERED, 1).alias("owner"), F.regexp_extract("slug", NUMBERED, 2).try_cast("long").alias("k"))
    split = split.where("k is not null").join(firsts.select(F.col("slug").alias("owner")), "owner", "left_semi")
    split = cut_lineage(split)
    theirs = groups.select(F.col(slug_col).alias("owner"), F.col("group_order").alias("_o"), F.lit(None).cast("string").alias("slug"))
    theirs = theirs.join(split.select("owner").distinct(), "owner", "left_semi")
    placed = rank_within(theirs.unionByName(split.select("owner", "_o", "slug")), "owner", ["_o"], "_p").where("slug is not null")
    # rivals of one owner are one row per slug; among them, only their own order is counted off
    nth = F.row_number().over(Window.partitionBy("owner").orderBy("_p"))
    return cut_lineage(placed.select("owner", "slug", (F.col("_p") - nth).alias("free")).join(split.select("slug", "k"), "slug"))


def _gaps(rivals: DataFrame) -> DataFrame:
    """``(owner, k, slug, skips, shift, gone)``: whether the owner skips number ``k`` because its rival has the name, the numbers that it
    skips below ``k`` (``gone``), and its ``shift``, 1 where the owner's own name went to the slug that it is a numbered name of.

    The owner reaches ``k`` with its group number ``k - shift - gone``, and skips it if that group comes after the rival's first. ``gone`` and
    ``shift`` follow from the smaller numbers and from the owner's owner, so repeating the rule settles them in that order; the
    table has a row for each rival only.
    """
    below = Window.partitionBy("owner").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    now = rivals.withColumn("skips", F.lit(True))
    while True:
        shift = now.select(F.col("slug").alias("owner"), F.when(F.col("skips"), 0).otherwise(1).alias("shift"))
        told = now.join(shift, "owner", "left").fillna({"shift": 0})
        told = told.withColumn("gone", F.coalesce(F.sum(F.col("skips").cast("long")).over(below), F.lit(0)))
        told = told.withColumn("_now", F.col("k") - F.col("shift") - F.col("gone") > F.col("free"))
        told = cut_lineage(told.withColumn("_moved", F.col("_now") != F.col("skips")))
        if not told.where("_moved").limit(1).count():
            return told.drop("_now", "_moved")
        now = told.select("owner", "k", "slug", "free", F.col("_now").alias("skips"))


def unique_slug(groups: DataFrame, slug_col: str = "_slug") -> DataFrame:
    """every group gets the first free name of its slug, slug_2, slug_3, ..., earlier groups (output order) first.

    A name is wanted by two slugs at most: the slug that reads so, whose first group asks for it, and the slug without its number.
    So the n-th group of a slug has the number n, one more if the slug's own name was gone, and one more for each number that it
    skips because another slug had the name before; these gaps are few rows (``_gaps``), added up by an as-of look-up. The number of jobs does
    not grow with the groups.
    """
    g = rank_within(groups, slug_col, ["group_order"], "_n")
    rivals = _rivals(groups, slug_col)
    if rivals.limit(1).count():
        gaps = _gaps(rivals)
        moved = gaps.where("not skips").select(F.col("slug").alias(slug_col), F.lit(1).alias("_shift"))
        g = g.join(moved, slug_col, "left").fillna({"_shift": 0})
        # the number that group n would have without gaps is n + shift; from k - gone on, a gap adds one
        steps = gaps.where("skips").select(F.col("owner").alias(slug_col), (F.col("k") - F.col("gone")).alias("_at"), (F.col("gone") + 1).alias("_add"))
        steps = steps.groupBy(slug_col, "_at").agg(F.max("_add").alias("_add")).select(slug_col, (F.col("_at") * 2).alias("_pos"), "_add")
        few = g.join(steps.select(slug_col).distinct(), slug_col, "left_semi").withColumn("_pos", (F.col("_n") + F.col("_shift")) * 2 + 1)
        both = last_before(few.unionByName(steps, allowMissingColumns=True), slug_col, "_pos", {"_gone": F.col("_add")}, hot_keys(few, slug_col))
        few = both.where("_n is not null").drop("_pos", "_add")
        rest = g.join(steps.select(slug_col).distinct(), slug_col, "left_anti").withColumn("_gone", F.lit(0).cast("long"))
        g = few.unionByName(rest).withColumn("_n", F.col("_n") + F.col("_shift") + F.coalesce("_gone", F.lit(0))).drop("_shift", "_gone")
    name = F.when(F.col("_n") == 1, F.col(slug_col)).otherwise(F.concat(F.col(slug_col), F.lit("_"), F.col("_n").cast("string")))
    return g.withColumn("slug", name).drop("_n", slug_col)


def dedup_report(entries: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Input, junk, id-group count after phase 1, entries without id, cross-matched by address (phase 2),
    key-groups formed in phase 3, entries moved in phase 4, final key-groups, output, reduction %
    (0 on empty input, Q19), active groups (auction date, parsed with the dedup's parser, on or after as_of)
    and expired = output - active (undated groups count as expired, as in the reference). One row; every
    figure is an aggregate."""
    n_in = entries.count()
    m = members.agg(
        F.count(F.lit(1)).alias("clean"),
        F.countDistinct(F.when(F.col("phase") == 1, F.col("group_id"))).alias("id_groups_phase1"),
        F.count(F.when(F.col("phase").isin(2, 3, 4), 1)).alias("without_id"),
        F.count(F.when(F.col("phase") == 2, 1)).alias("cross_matched_address"),
        F.count(F.when(F.col("phase") == 4, 1)).alias("cross_matched_title_size"),
    ).first()
    gstats = groups.agg(
        F.count(F.lit(1)).alias("output"),
        F.count(F.when(F.col("group_kind") == "id", 1)).alias("id_groups"),
        F.count(F.when(F.col("group_kind") == "key", 1)).alias("key_groups"),
        F.count(F.when(F.col("is_active_dedup"), 1)).alias("active"),
    ).first()
    out = gstats["output"]
    red = round(100.0 - out / n_in * 100.0, 1) if n_in else 0.0
    spark = entries.sparkSession
    row = (n_in, n_in - m["clean"], m["id_groups_phase1"], m["without_id"], m["cross_matched_address"],
           m["cross_matched_title_size"], gstats["id_groups"], gstats["key_groups"], out, red, gstats["active"],
           out - gstats["active"])
    return spark.createDataFrame(
        [row],
        "input long, junk long, id_groups_phase1 long, without_id long, cross_matched_address long, "
        "cross_matched_title_size long, id_groups long, key_groups long, output long, reduction_pct double, "
        "active long, expired long",
    )
