"""What the jobs shuffle, sort and keep, by their plans and results: texts stay out of the steps that only need keys."""

from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_observations_are_ordered_before_their_texts_are_made(spark):
    from bidscope.sources.fixture import observations

    plan = _plan(observations(spark, SF001))
    at = plan.index("rangepartitioning(scan_date")
    assert "Storey" in plan[:at] and "format_number" in plan[:at]
    assert "Storey" not in plan[at:] and "format_number" not in plan[at:]


PLAIN_PAGE = (
    '<html><head><title>Auction results</title></head><body><p>Result(s): 12</p>\n<div class="row">\n<div class="col"><div class="card">\n'
    '<img src="/images/1.jpg" alt="">\n<p class="text-muted">Residensi A &amp; B</p>\n<h5 class="fw-bold">No. 1</h5>\n'
    '<a class="stretched-link" href="/property/L1/1" title="Shop &amp; Office">Shop &amp; Office</a>\n<span>RM120,000</span>\n'
    "<span>3 Oct 2001 (Wed)</span>\n</div></div>\n</div></body></html>")


def test_plain_pages_need_no_parser(monkeypatch):
    from bidscope.sources import harvest as HV

    by_pattern = HV.cards_of_page(1, PLAIN_PAGE)
    with monkeypatch.context() as m:
        m.setattr(HV, "_plain_tokens", lambda html: None)
        assert HV.cards_of_page(1, PLAIN_PAGE) == by_pattern and len(by_pattern) == 1

    def fed(self, data):
        raise RuntimeError("the parser was asked")

    monkeypatch.setattr(HV.HTMLParser, "feed", fed)
    assert HV.cards_of_page(1, PLAIN_PAGE) == by_pattern


def test_pattern_and_parser_read_pages_alike(monkeypatch):
    import random

    from bidscope.sources import harvest as HV

    def outline(html):
        page = HV._Outline(html)
        return page.pieces, [(e.tag, e.attrs, e.begin, e.end, e.at, e.last, e.parent and e.parent.at) for e in page.elements]

    plain = ['<div>', "</div>", '<p class="a b">', "</p>", '<a href="/property/1&amp;2" class="stretched-link">', "</a>", "<title>x</title>", "<br>",
             "text ", "RM12,000", "3 Oct 2001 (Wed)", "&amp;", "&lt", "& ", "&notit;", ">", '"', "\n", "<template>", "</template>", '<a a="1" a="2">']
    other = ["<", "<!-- c -->", "<script>", "</script>", "<DIV>", "<p x=1>", "</p >", "<br/>", '<a title="a > b">', '<a title="&ltx">', "<title>", "<![CDATA[x]]>",
             "<textarea>", "<svg>", "</ x>", '<a b="c"d="e">']
    rnd = random.Random(7)
    pages = ["".join(rnd.choices(plain + other * (k % 2), k=12)) for k in range(2000)]
    assert sum(HV._plain_tokens(p) is not None for p in pages) > 500
    got = [outline(p) for p in pages]
    monkeypatch.setattr(HV, "_plain_tokens", lambda html: None)
    assert got == [outline(p) for p in pages]


def test_link_of_a_card_is_chosen_once(spark):
    """The fields that the link gives are read from one column, not worked out again for each of them."""
    from bidscope.sources import harvest as HV

    cards = HV.split_cards(spark.createDataFrame([(1, PLAIN_PAGE)], "page_id long, html string"))
    fields = HV.extract_card_fields(cards, "https://x", "https://x/s")
    assert _plan(fields).count("array_max") == 1
    row = fields.first()
    assert (row["title"], row["listing_id"], row["price_value"], row["reject_reason"]) == ("Shop & Office", "L1", 120000, None)


def test_tables_between_steps_are_kept_in_columns(spark):
    """A checkpoint would hold whole rows uncompressed; its plan reads an RDD, and every column of it."""
    from bidscope.operators.sequence import dense_index
    from bidscope.session import cut_lineage

    df = spark.range(50).selectExpr("id", "cast(id % 7 as string) AS name")
    for table in (cut_lineage(df), dense_index(df, ["name", "id"])):
        plan = _plan(table.select("id"))
        assert "ExistingRDD" not in plan and "ReadSchema: struct<id:bigint" in plan
    assert [r["idx"] for r in dense_index(df, ["name", "id"]).orderBy("name", "id").collect()] == list(range(1, 51))


def _stored_folders(spark) -> set:
    import os

    from bidscope.session import checkpoint_dir

    base = checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(base) if not f.startswith("bidscope")}


def test_a_batch_leaves_only_the_database(spark, small_plans):
    """Rounds of matching and the batch's own tables are deleted once they are not read any more."""
    from bidscope.catalog import context as C
    from bidscope.plans import replay as RP
    from bidscope.sources.snapshots import scratch_path

    obs = C.obsn(spark, SF001).where("scan_date < '1995-07-01'")
    base, before = scratch_path(spark, "database"), _stored_folders(spark)
    version = RP.apply_batch(spark, base, obs)
    assert _stored_folders(spark) == before
    assert RP.read_entities(spark, version).count() > 0


def test_snapshot_documents_are_written_compressed_and_unshuffled(spark, tmp_path):
    from pyspark.sql import functions as F

    from bidscope.catalog import context as C
    from bidscope.plans import replay as RP
    from bidscope.sources import snapshots as S

    obs = C.obsn(spark, SF001).where("scan_date < '1995-07-01'")
    landing = f"{tmp_path}/landing"
    S.write_snapshot_files(obs, landing, rows_per_doc=50)
    files = [str(p) for p in (tmp_path / "landing").rglob("part-*")]
    assert files and all(f.endswith(".txt.gz") for f in files)
    assert S.read_snapshot_files(spark, files).count() == obs.count()
    version = RP.replay_files(spark, landing, f"{tmp_path}/database")
    assert RP.read_log(spark, version).agg(F.sum("listings_seen")).first()[0] == obs.count()


def test_history_points_shuffle_their_rows_once(spark):
    from bidscope.catalog import context as C
    from bidscope.operators.history import detect_changes, history_rounds, change_points, price_points

    o = C.obsn(spark, SF001)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _plan(price_points(o, "p_partkey")).count("Exchange hashpartitioning") == 1
        assert "Join" not in _plan(detect_changes(o, "p_partkey", hot_rows=1 << 20))
        assert "Join" not in _plan(history_rounds(*change_points(o, "p_partkey"), "p_partkey"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_previous_values_by_window_and_by_segments_agree(spark):
    from bidscope.operators.history import previous_values

    rows = [(e, f"2001-0{1 + (s * e) % 4}-01", s, f"v{(s * 7 + e) % 3}" if s % 5 else None) for e in range(1, 6) for s in range(40 if e == 1 else 6)]
    df = spark.createDataFrame(rows, "e long, scan_date string, obs_seq long, v string")
    got = [sorted(map(str, previous_values(df, "e", ["v"], seg_bits=2, hot_rows=h).select("e", "scan_date", "obs_seq", "v", "prev_v", "is_first").collect())) for h in (None, 10, 1000)]
    assert got[0] == got[1] == got[2]


def test_snapshot_documents_are_compressed_and_shuffled_once(spark, tmp_path):
    import os

    from bidscope.catalog import context as C
    from bidscope.sources.snapshots import read_snapshots, write_snapshot_json
    from pyspark.sql import functions as F

    o = C.obs(spark, SF001).withColumn("raw_id", F.col("obs_seq").cast("string"))
    write_snapshot_json(o, str(tmp_path / "s"), rows_per_doc=100)
    names = [n for _, _, fs in os.walk(tmp_path) for n in fs if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert read_snapshots(spark, str(tmp_path / "s"), multi_line=False).count() == o.count()


def test_landed_scans_are_taken_in_scan_order(spark):
    from bidscope.catalog import context as C
    from bidscope.sources.snapshots import scratch_path
    from bidscope.streaming import streams as ST
    from pyspark.sql import functions as F

    o = C.obsn(spark, SF001)
    landing = scratch_path(spark, "landing-order")
    days = sorted(r[0] for r in o.select("scan_date").distinct().collect())
    first = o.where(F.col("scan_date") != F.lit(days[3]))
    assert ST.land_scans(first, landing) == [d for d in days if d != days[3]]
    ST.land_scans(o.where(F.col("scan_date").isin(days[3], days[5])), landing)
    seen = []
    ST._run(lambda ck: ST.stream_snapshots(spark, landing, o.schema).writeStream.option("checkpointLocation", ck).foreachBatch(
        lambda b, _: seen.extend(r[0] for r in b.select("scan_date").distinct().collect())), "order", spark)
    assert seen == [d for d in days if d != days[3]] + [days[3], days[5]]


def test_points_of_small_groups_are_shuffled_once(spark):
    """Merged histories (F5): by group alone where no group is very large, with the same rows as by distinct points first."""
    import random

    from bidscope.operators.history import merge_histories

    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.choice(["RM1", "RM2", ""]), rnd.choice(["", "2001-01-01", "2001-02-01"]), (rnd.randrange(3), n)) for n in range(300)]
    points = spark.createDataFrame(rows, "group_id string, price string, date string, arrival struct<m:int,p:int>")
    small, any_size = (merge_histories(points, "group_id", "price", s) for s in (True, False))
    assert (_plan(small).count("Exchange hashpartitioning"), _plan(any_size).count("Exchange hashpartitioning")) == (1, 2)
    assert sorted(small.collect()) == sorted(any_size.collect()) and small.count() > 10


def test_points_of_both_fields_are_one_table(spark):
    from bidscope.catalog import context as C
    from bidscope.operators.history import change_points

    o = C.obsn(spark, SF001)
    where = ["p_partkey", "scan_date", "obs_seq"]
    pp, ap = change_points(o, "p_partkey")
    both = change_points(o, "p_partkey", together=True)
    assert sorted(both.where("price_changed").select(*where, "price", "date").collect()) == sorted(pp.select(*where, "price", "date").collect())
    assert sorted(both.where("auction_date_changed").select(*ap.columns).collect()) == sorted(ap.collect())
    assert both.where("not price_changed and not auction_date_changed").count() == 0


def test_phases_of_the_dedup_shuffle_keys_only(spark):
    """The best entries, by which key-groups move to id-groups, are found on the keys in tables of their own: the members' plan neither
    packs whole entries into an aggregate nor repeats the phases before it."""
    from bidscope.catalog import context as C
    from bidscope.plans.dedup import assign_groups

    plan = assign_groups(C.properties_raw(spark, SF001)[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "max_by" not in plan


def test_the_rebuilt_log_does_not_join_the_labels_again(spark):
    """every branch of the log reads the stored rows; the labels are joined to the observations once."""
    from bidscope.catalog import context as C
    from bidscope.plans.rebuild import rebuilt

    lab = C.resolved(spark, SF001)
    assert "rule" in C.labels(spark, SF001).columns and "title" not in C.labels(spark, SF001).columns
    log = rebuilt(lab)["log"]
    assert "_seq" not in log._jdf.queryExecution().optimizedPlan().toString().replace("obs_seq", "")
    assert log.agg({"listings_seen": "sum"}).first()[0] == lab.count()


def test_the_digest_asks_for_the_states_it_shows(spark):
    """the same digest from the states of at most 2 k entities as from all of them."""
    from bidscope.catalog import context as C
    from bidscope.operators.history import current_state
    from bidscope.plans import rebuild as RB

    lab, asked = C.resolved(spark, SF001), []

    def some(entities):
        asked.extend(entities)
        return current_state(C.resolved(spark, SF001, entities), "entity_id")

    scan = RB.latest_scan_date(lab)
    a = RB.scan_digest(RB.told_rows(lab), some, "entity_id", scan).orderBy("section", "rank").collect()
    b = RB.scan_digest(lab, current_state(lab, "entity_id"), "entity_id", scan).orderBy("section", "rank").collect()
    assert a == b and 0 < len(asked) <= 10


def test_a_batch_is_assigned_from_the_labels_of_earlier_rows(spark):
    """plain earlier observations and their labels, in place of both joined with all texts."""
    from pyspark.sql import functions as F

    from bidscope.catalog import context as C
    from bidscope.operators.resolve import assign_entities

    o, want = C.obsn(spark, SF001), {tuple(r) for r in C.resolved(spark, SF001).select("obs_seq", "entity_id", "match_rule").collect()}
    cut = sorted(r[0] for r in o.select("scan_date").distinct().collect())[-2]
    got = assign_entities(o.where(F.col("scan_date") >= cut), o.where(F.col("scan_date") < cut), labels=C.labels(spark, SF001))
    got = {tuple(r) for r in got.select("obs_seq", "entity_id", "match_rule").collect()}
    assert got and got <= want


def test_texts_are_parsed_after_equal_ones_are_one(spark):
    """b7_b30_parse (F14): the shuffle holds the texts alone, and each distinct row is parsed once."""
    from bidscope.catalog import all_entries

    plan = _plan(all_entries()["b7_b30_parse"].fn(spark, SF001))
    at = plan.index("Exchange hashpartitioning")
    assert "regexp_extract" in plan[:at] and "regexp_extract" not in plan[at:]


def test_amounts_dates_and_strips_of_odd_texts(spark):
    from bidscope import functions as X

    texts = ["500k", " RM 1.5 m", "1,000\t", "RM2M\n", "5kk", "k", "", None, "1.k", "\x0b\f 7", "3\t Oct \n 2001 (Wed)", "x 3 Oct 2001", "31 Foo 2001", "3 Oct 20011"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", X.parse_amount("t").alias("a"), X.parse_auction_date("t").cast("string").alias("d"), X.parse_date_anywhere("t").cast("string").alias("e"), X.pystrip("t").alias("s"),
                    X.price_value("t").alias("p")).orderBy("i").collect()
    assert [r["a"] for r in got] == [500000.0, 1500000.0, 1000.0, 2000000.0, None, None, None, None, None, 7.0, None, None, None, None]
    assert [r["d"] for r in got] == [None] * 10 + ["2001-10-03", None, None, "2001-10-03"]
    assert [r["e"] for r in got] == [None] * 10 + ["2001-10-03", "2001-10-03", None, "2001-10-03"]
    assert [r["s"] for r in got] == [t and t.strip() for t in texts]
    assert [r["p"] for r in got] == [500, 1, 1000, 2, 5, 0, 0, 0, 1, 7, 3, 3, 31, 3]


def _numbered(spark, gaps=False):
    from pyspark.sql import functions as F

    rows = spark.range(0, 500, 1, 4).select(F.expr("date_add(date'2001-01-01', cast(id / 90 as int))").alias("scan_date"), F.expr("(id div 125) * 8589934592L + id % 125").alias("obs_seq"))
    return rows.where("obs_seq % 7 <> 3") if gaps else rows


def test_places_in_a_scan_follow_from_counts(spark):
    """a15 and all that read pages (F7): rows are not shuffled to be numbered; numbers with gaps get the same places by a sort."""
    from bidscope.operators.sequence import rank_in_group

    for gaps in (False, True):
        rows = _numbered(spark, gaps)
        ranked = rank_in_group(rows, "scan_date", "obs_seq")
        plan = _plan(ranked)  # without gaps the counts alone are shuffled
        assert gaps or ("rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan)
        got = sorted((r["scan_date"], r["obs_seq"], r["rank"], r["group_size"]) for r in ranked.collect())
        by_scan = {}
        for r in sorted(rows.collect()):
            by_scan.setdefault(r["scan_date"], []).append(r["obs_seq"])
        assert got == [(d, s, k, len(v)) for d, v in sorted(by_scan.items()) for k, s in enumerate(v)]


def test_pages_are_whole_however_the_rows_are_read(spark, tmp_path):
    from pyspark.sql import functions as F

    from bidscope.sources.fixture import TEXT_COLUMNS, card_pages

    rows = _numbered(spark).select("*", *[F.concat(F.lit(c), F.col("obs_seq").cast("string")).alias(c) for c in TEXT_COLUMNS], F.col("obs_seq").alias("p_partkey"))
    rows.write.parquet(str(tmp_path / "obs"))
    stored = spark.read.parquet(str(tmp_path / "obs"))
    key = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(key), []
    try:
        for size, table in ((before, stored), ("2k", stored), (before, stored.repartition(5))):
            spark.conf.set(key, size)
            seen.append(sorted((r["scan_date"], r["page_id"], r["html"]) for r in card_pages(table).collect()))
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 5 * 8 + 5
    last = {day: max(p for d, p, _ in seen[0] if d == day) for day, _, _ in seen[0]}
    assert all(html.count("/images/") == (13 if page < last[day] else {8: 7, 5: 3}[page]) for day, page, html in seen[0])
    first = seen[0][0][2]
    assert [first.index(f"/property/listing_id{k}/") for k in range(12)] == sorted(first.index(f"/property/listing_id{k}/") for k in range(12))


def test_dedup_of_a_run_shuffles_what_is_read(spark):
    """a12 (F4): a limit per key before the shuffle, and no column that the reader does not use."""
    from bidscope.sources import harvest as HV

    names = ("title", "price", "auction_date", "location", "size", "header_full", "image_url", "listing_url")
    rows = [(p, c, *("Shop", "RM1", "d", "KL", s, "A", f"i{p}{c}", f"u{p}{c}")) for p, c, s in ((2, 0, "9"), (1, 1, "9"), (1, 0, "9!"), (3, 0, "8"), (3, 1, "8."))]
    df = spark.createDataFrame(rows, "page_id long, card_index int, " + ", ".join(f"{n} string" for n in names))
    out = HV.collapse_ids(HV.dedup_run(df))
    plan = _plan(out.select("property_id", "property_hash", "page_id", "card_index"))
    assert plan.count("WindowGroupLimit") == 4 and "image_url" not in plan.split("Project")[1]
    assert "min_by" not in plan and "max_by" not in plan
    got = sorted((r["property_id"], r["page_id"], r["card_index"], r["image_url"]) for r in out.collect())
    assert got == [("shop_kl_8_a", 3, 1, "i31"), ("shop_kl_9_a", 1, 1, "i11")]
    assert [len(r[0]) for r in out.select("property_hash").collect()] == [32, 32] and out.columns == [*df.columns, "property_hash", "property_id"]


def test_sizes_known_go_past_the_join(spark):
    """a14 (F5): only rows without a size meet the detail pages."""
    from bidscope.sources import harvest as HV

    rows = [(1, "Size not specified", "x/property/1"), (2, "9 sq.ft", "x/property/1"), (3, "Size not specified", "x/other/1"), (4, None, None), (5, "Size not specified", None), (6, "Size not specified", "x/property/2")]
    df = spark.createDataFrame(rows, "k int, size string, listing_url string")
    pages = spark.createDataFrame([("x/property/1", "Size: 700 sq ft"), ("x/property/1", "Size: 800 sq ft"), ("x/other/1", "Size: 7 sq ft")], "listing_url string, html string")
    out = HV.fill_size_from_detail(df, pages)
    assert "Union" in _plan(out)
    assert sorted(tuple(r) for r in out.select("k", "size").collect()) == [(1, "700 sq.ft"), (2, "9 sq.ft"), (3, "Size not specified"), (4, None), (5, "Size not specified"), (6, "Size not specified")]


def test_state_and_points_of_one_pass_are_those_of_two(spark, monkeypatch):
    """f5_merge_price_history (F9), and F8, F15: one shuffle of the rows gives what the two operators give, also for odd rows and hot entities."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from bidscope.catalog import context as C
    from bidscope.operators import history as H

    odd = C.obsn(spark, SF001).where("p_partkey < 60").withColumn("obs_seq", F.xxhash64("obs_seq")).withColumns(
        {c: F.when(F.xxhash64("obs_seq", F.lit(c)) % 3 != 0, F.col(c)) for c in ("title", "price", "auction_date", "last_updated", "size", "header_full")})
    odd = odd.withColumn("price_note", F.concat("price", F.lit("!")))
    state = H.current_state(odd, "p_partkey", ("price_note",))
    points = H.change_points(odd, "p_partkey", together=True)
    w = Window.partitionBy("p_partkey").orderBy("scan_date", "obs_seq")
    at = [F.when(F.col(f"{c}_changed"), F.count(F.when(F.col(f"{c}_changed"), 1)).over(w).cast("int")).alias(f"{c}_pos") for c in ("price", "auction_date")]
    points = points.select("p_partkey", "scan_date", "obs_seq", "price", "auction_date", "date", "url", *at)
    rows = lambda df: sorted(map(repr, df.collect()))
    expected = rows(state), rows(points)
    got = H.state_and_points(odd, "p_partkey", ("price_note",))
    assert (rows(got[0]), rows(got[1])) == expected and got[0].schema.simpleString() == state.schema.simpleString()

    def separate(*_, **__):
        raise RuntimeError("worked out on its own")

    with monkeypatch.context() as m:
        m.setattr(H, "HOT_ROWS", 3)
        hot = H.state_and_points(odd, "p_partkey", ("price_note",))
        assert (rows(hot[0]), rows(hot[1])) == expected
    monkeypatch.setattr(H, "current_state", separate)
    monkeypatch.setattr(H, "change_points", separate)
    H.state_and_points(odd, "p_partkey")


def test_rows_of_snapshot_files_are_numbered_without_a_sort(spark, tmp_path, monkeypatch):
    """a4_replay_scan_log, d10_replay_new_details (F2, F10): files are written in the order of counted places, and their rows are numbered by
    the lengths of the files."""
    from pyspark.sql import functions as F

    from bidscope.operators import sequence
    from bidscope.plans import replay as RP
    from bidscope.session import stored
    from bidscope.sources import snapshots as S

    def sort(*_, **__):
        raise RuntimeError("sorted")

    monkeypatch.setattr(sequence, "dense_index", sort)
    rows = _numbered(spark).withColumn("title", F.concat(F.lit("t"), F.col("obs_seq").cast("string")))
    S.write_snapshot_files(rows, str(tmp_path / "landing"), rows_per_doc=40)
    paths = sorted(str(p) for p in (tmp_path / "landing").rglob("*.txt.gz"))
    assert len(paths) == 5 * 3 + 2
    read = RP._numbered(stored(S.read_snapshot_files(spark, paths), "read"), 1 << 50)
    assert "rangepartitioning" not in _plan(read) and "SortMergeJoin" not in _plan(read)
    got = sorted((r["obs_seq"], r["scan_date"], r["title"], r["raw_id"]) for r in read.collect())
    want = sorted((r["scan_date"], r["obs_seq"], r["title"]) for r in rows.collect())
    assert got == [((1 << 50) + k, d, t, str(q)) for k, (d, q, t) in enumerate(want)]
