"""Cases found in review: entity matching, slugs, saved filters, caches, state files, card finder."""

import datetime
import random

import pytest

from bidscope import functions as X
from bidscope.operators.filters import ANY_TYPE, filter_candidates, filter_keys, match_saved_filters, parsed_filters
from bidscope.operators.resolve import assign_entities, resolve_entities
from bidscope.plans.dedup import unique_slug
from bidscope.plans.publish import one_per_address
from bidscope.sources.harvest import cards_of_page, page_inventory
from bidscope.sources.snapshots import read_properties

OBS = "obs_seq long, scan_date date, title string, location string, size string, header_full string, listing_id string"


def observations(spark, rows, start=0):
    return spark.createDataFrame([(start + k, datetime.date(2024, 1, 1 + k // 100), *r) for k, r in enumerate(rows)], OBS)


def labels(df):
    return [r["entity_id"] for r in df.orderBy("obs_seq").collect()]


def test_one_listing_id_with_and_without_address_is_one_entity(spark):
    a, b = labels(resolve_entities(observations(spark, [("A", "KL", "1 sqft", "No 1, Jalan Satu", "L1"), ("B", "KL", "2 sqft", None, "L1")])))
    assert a == b


def test_one_listing_id_with_two_addresses_is_two_entities(spark):
    a, b = labels(resolve_entities(observations(spark, [("A", "KL", "1 sqft", "No 1, Jalan Satu", "L1"), ("B", "KL", "2 sqft", "No 2, Jalan Dua", "L1")])))
    assert a != b


def test_equal_new_rows_of_a_batch_share_an_entity(spark):
    row = ("New", "KL", "5 sqft", "No 5, Jalan Lima", "N1")
    old = resolve_entities(observations(spark, [("A", "KL", "1 sqft", "No 1, Jalan Satu", "L1"), ("A", "KL", "1 sqft", "No 1, Jalan Satu", None)]))
    batch = observations(spark, [row, row, ("Z", "KL", "7 sqft", None, "L1"), ("A", "KL", "1 sqft", "No 1, Jalan Satu", None)], start=500)
    got = assign_entities(batch, old).orderBy("obs_seq").collect()
    assert [r["match_rule"] for r in got] == ["new", "listing_id", "listing_id", "stable_key"]
    known = labels(old)[0]
    assert got[0]["entity_id"] == got[1]["entity_id"] != known and [r["entity_id"] for r in got[2:]] == [known, known]


def test_slugs_are_unique_and_earlier_groups_choose_first(spark):
    slugs = ["a", "a", "a_2", "a_2_2", "a", "b"]
    g = spark.createDataFrame([(f"g{k}", s, (0, k)) for k, s in enumerate(slugs)], "group_id string, _slug string, group_order struct<k:int,o:long>")
    got = {r["group_id"]: r["slug"] for r in unique_slug(g).collect()}
    assert [got[f"g{k}"] for k in range(6)] == ["a", "a_2", "a_2_2", "a_2_2_2", "a_3", "b"]


def served(slugs):
    """Names by serving the groups one after the other."""
    used, out = set(), []
    for s in slugs:
        name, n = s, 2
        while name in used:
            name, n = f"{s}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


def slug_groups(spark, slugs):
    return spark.createDataFrame([(f"g{k}", s, (0, k)) for k, s in enumerate(slugs)], "group_id string, _slug string, group_order struct<k:int,o:long>")


@pytest.mark.parametrize("seed,pool", [(1, ["a", "a_2", "a_3", "a_2_2", "a_4", "a_2_3", "b", "a_5", "a_02", "a_1", "a_3_2"]), (2, ["a", "a", "a", "a_2", "a_3", "a_5", "a_6", "a_2_2"]), (3, ["a", *(f"a_{k}" for k in range(2, 60))])])
def test_slugs_as_if_served_one_after_the_other(spark, seed, pool):
    r = random.Random(seed)
    for n in (30, 150):
        slugs = [r.choice(pool) for _ in range(n)]
        got = {x.group_id: x.slug for x in unique_slug(slug_groups(spark, slugs)).collect()}
        assert [got[f"g{k}"] for k in range(n)] == served(slugs)


def test_jobs_for_slugs_do_not_grow_with_the_groups(spark):
    """A slug with 5, 50 and 500 groups behind one foreign ``x_2``: the same number of jobs."""
    jobs = []
    for n in (5, 50, 500):
        slugs = ["x", "x_2", *["x"] * n]
        spark.sparkContext.setJobGroup(f"slugs-{n}", "slugs")
        got = {x.group_id: x.slug for x in unique_slug(slug_groups(spark, slugs)).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"slugs-{n}")))
        assert [got[f"g{k}"] for k in range(n + 2)] == served(slugs)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs) <= min(jobs) + 3, jobs  # AQE may add a stage for an empty or a larger side


def test_blank_dedup_slug_is_property(spark):
    df = spark.createDataFrame([("", "", "")], "t string, l string, s string")
    assert df.select(X.property_slug("t", "l", "s", None, 120)).first()[0] == "property"


def test_listing_without_type_matches_a_filter_without_type(spark):
    filters = spark.createDataFrame([(1, "under 500k", None, None, 500000.0, None, None, None)],
                                    "filter_id long, text string, type string, min_price double, max_price double, location string, city string, search string")
    listings = spark.createDataFrame([(1, None, 400000, "KL", "x", False), (2, "Land", 300000, "KL", "y", False)],
                                     "p_partkey long, property_type string, price_value long, location string, search_text string, is_expired boolean")
    counts, pairs = match_saved_filters(filters, listings, "p_partkey")
    assert counts.first()["n_matches"] == 2 and pairs.count() == 2


FILTER = "filter_id long, text string, type string, min_price double, max_price double, location string, city string, search string"
LISTING = "p_partkey long, property_type string, price_value long, location string, search_text string, is_expired boolean"


def fits(f, x):
    """Whether a listing meets a filter, condition by condition."""
    _, _, kind, lo, hi, location, city, search = f
    _, of_type, price, place, text, expired = x
    price, text = price or 0, text or ""
    return (not expired and (kind is None or of_type == kind) and (not lo or price >= lo) and (not hi or price <= hi) and (location is None or city is not None or location.lower() in (place or "").lower())
            and (city is None or city in text) and (search is None or all(t in text for t in search.lower().split())))


def test_saved_filters_by_index_equal_all_pairs(spark):
    r = random.Random(8)
    words = ["shah", "alam", "jalan", "kl", "taman", "ab", "residensi"]
    listings = [(k, r.choice(["Land", "Landed", None]), r.choice([None, 0, 999, 1000, 1001, r.randint(0, 3_000_000), 3 * 10 ** 9]), r.choice(["Kuala Lumpur", "Selangor", None, "KL"]),
                 r.choice([None, " ".join(r.choice(words) for _ in range(5))]), r.random() < 0.1) for k in range(300)]
    filters = [(k, "t", r.choice([None, "Land", "Landed"]), r.choice([None, 0.0, 1000.0, 500_000.5, 2e9]), r.choice([None, 0.0, 999.0, 1000.0, 1_500_000.0, 4e9]), r.choice([None, None, "Selangor", "kl"]),
                r.choice([None, None, "shah alam", "taman"]), r.choice([None, None, "jalan", "Shah ab", "kl"])) for k in range(80)]
    f, x = spark.createDataFrame(filters, FILTER), spark.createDataFrame(listings, LISTING)
    counts, pairs = match_saved_filters(f, x, "p_partkey")
    want = {(a[0], b[0]) for a in filters for b in listings if fits(a, b)}
    got = [tuple(p) for p in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {c.filter_id: c.n_matches for c in counts.collect()} == {a[0]: sum(1 for p in want if p[0] == a[0]) for a in filters}


def test_price_ranges_are_made_of_few_disjoint_intervals(spark):
    ranges = [(0, 0), (1, 1), (5, 9), (0, 1), (7, 1000), (333, 99_999)]
    f = spark.createDataFrame([(k, "t", None, lo * 1000.0, hi * 1000.0, None, None, None) for k, (lo, hi) in enumerate(ranges)], FILTER)
    cells = {k: [] for k in range(len(ranges))}
    for row in filter_keys(f).collect():
        _, level, cell, of_type = row.key.split(":")
        assert of_type == ANY_TYPE and not row.by_run
        cells[row.filter_id] += [(int(cell) << int(level), (int(cell) + 1) << int(level))]
    for k, (lo, hi) in enumerate(ranges):
        spans = sorted(cells[k])
        assert spans[0][0] == lo and spans[-1][1] == (hi + 1 if hi else 1 << 20) and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 40


def test_candidates_of_saved_filters_are_few(spark):
    """On the fixture's filters and listings: fewer than ten candidates for each match."""
    from bidscope.catalog import context as C
    from bidscope.catalog.q_enrich import _saved
    from bidscope.operators.rank import dedup_listings
    from conftest import SF01

    f, x = parsed_filters(_saved(spark, SF01)), dedup_listings(C.published(spark, SF01))
    _, pairs = match_saved_filters(f, x, C.ENTITY)
    act = x.where("not is_expired").selectExpr(C.ENTITY, "property_type", "price_value", "lower(coalesce(location, '')) as _loc", "coalesce(search_text, '') as _st")
    assert filter_candidates(f, act, C.ENTITY).count() < 10 * pairs.count()


def test_pages_by_position_follow_each_other(spark):
    """Page after page by the last row seen gives the rows of the whole order."""
    from bidscope.operators.predicates import ListingSpec
    from bidscope.plans.listing_query import listing_queries

    r = random.Random(4)
    rows = [(k, r.randint(1, 6) * 1000, r.choice(["1 sqft", "2 sqft", None]), r.choice(["Land", "Landed"]), False, "x", "KL", None, None, None, "t", "a") for k in range(50)]
    df = spark.createDataFrame(rows, "arrival long, price_value long, size string, property_type string, is_expired boolean, search_text string, location string, auction_date string, auction_text string, discount string, title string, address string")
    specs = {"dear": ListingSpec(sort="price_desc", page_size=7), "land": ListingSpec(types=["Land"], sort="size_asc", page_size=4)}
    order = {"dear": sorted(rows, key=lambda x: (-x[1], x[0])), "land": sorted((x for x in rows if x[3] == "Land"), key=lambda x: (int((x[2] or "0")[0]), x[0]))}
    seen, after = {"dear": [], "land": []}, {}
    for _ in range(4):
        page = sorted(listing_queries(df, specs, "2024-01-01", [], dedup=False, after=after).collect(), key=lambda x: x["rank"])
        for x in page:
            seen[x.spec].append(x.arrival)
            after[x.spec] = (x.sort_key, x.arrival)
            assert x.total == len(order[x.spec])
    assert seen["dear"] == [x[0] for x in order["dear"][:28]] and seen["land"] == [x[0] for x in order["land"][:16]]


def test_caches_with_repeated_addresses_do_not_fan_out(spark):
    cache = spark.createDataFrame([(" A ", 1.0, 2.0, "full"), ("A", 0.5, 2.0, "full"), ("", 1.0, 1.0, "full")], "address string, lat double, lng double, q string")
    assert [tuple(r) for r in one_per_address(cache, "lat", "lng", "q").collect()] == [("A", 0.5, 2.0, "full")]


def test_only_a_missing_state_reads_as_empty(spark, tmp_path):
    schema = spark.range(1).schema
    assert read_properties(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(Exception, match="(?i)scheme|file ?system"):
        read_properties(spark, "nosuchfs://host/state", schema).count()


def card(k, address=True):
    head = f'<h5 class="FW-bold">No {k}, Road</h5>' if address else ""
    return f'<div class="card"><a class="stretched-link" href="/property/L{k}">House {k}</a>{head}<p class="text-muted">Park, KL</p><b>RM{100 + k},000</b> <i>3 Oct 2001 (Wed)</i></div>'


def test_a_card_without_address_does_not_take_its_neighbours():
    rows = cards_of_page(1, "<html><body><div class='row'>" + card(1) + card(2, address=False) + card(3) + "</div></body></html>")
    assert [r[5] for r in rows] == ["No 1, Road", None, "No 3, Road"] and [r[1] for r in rows] == [0, 1, 2]


@pytest.mark.parametrize("n", [12, 48, 192])
def test_links_grow_with_the_cards(n):
    rows = cards_of_page(1, "<div>" + "".join(card(k) for k in range(n)) + "</div>")
    assert len(rows) == n and sum(len(r[7]) for r in rows) == n


def test_pages_without_stretched_links_use_prices():
    rows = cards_of_page(1, "<html><ul><li><b>RM120,000</b><span>4 Oct 2001 (Thu)</span></li><li>RM1 only</li><li><script>RM9</script>RM5,000 on 5 Oct 2001 (Fri)</li></ul></html>")
    assert [(r[2], r[3]) for r in rows] == [(2, "RM120,0004 Oct 2001 (Thu)"), (2, "RM120,0004 Oct 2001 (Thu)RM1 onlyRM5,000 on 5 Oct 2001 (Fri)"), (2, "RM5,000 on 5 Oct 2001 (Fri)")]
    assert cards_of_page(1, None) == [] and cards_of_page(1, "<div><p>RM5") == []


def test_page_count_has_no_cap(spark):
    df = spark.createDataFrame([(1, "Result(s): 120,000")], "page_id long, html string")
    assert page_inventory(df).first()["total_pages"] == 10_000 and page_inventory(df, max_pages=600).first()["total_pages"] == 600
