"""Snapshot documents in the reference layout, the stateful streaming variant, and harvest edge cases."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from bidscope.catalog import context as C
from bidscope.operators.history import detect_changes
from bidscope.sources import harvest as HV
from bidscope.sources.snapshots import read_snapshots, scratch_path
from bidscope.streaming import streams as ST
from conftest import SF001


def test_read_reference_snapshot_documents(spark):
    d = tempfile.mkdtemp(prefix="snap-", dir="/tmp")
    doc = {"scan_date": "2025-09-09T06:15:27", "scraping_stats": {"total_pages": 2, "success_rate": 100.0},
           "properties": {"shop_office_kl_": {"title": "Shop Office", "price": "RM350,000", "price_value": 350000,
                                              "auction_date": "10 Sep 2025 (Wed)", "location": "Kuala Lumpur"},
                          "land_": {"title": "Agricultural Land", "price": "RM90,000", "listing_id": "abc"}}}
    with open(os.path.join(d, "2025-09-09.json"), "w") as f:
        json.dump(doc, f, indent=2)
    with open(os.path.join(d, "2025-09-10.json"), "w") as f:
        f.write("{ this is not json")
    rows = read_snapshots(spark, d).orderBy("raw_id").collect()
    assert [r["raw_id"] for r in rows] == ["land_", "shop_office_kl_"]
    assert rows[1]["price_value"] == 350000 and str(rows[1]["scan_date"]) == "2025-09-09"
    assert rows[0]["listing_id"] == "abc" and rows[0]["location"] is None


def test_stateful_stream_changes_equal_batch(spark):
    o = C.obsn(spark, SF001)
    landing = scratch_path(spark, "landing-test")
    ST.land_scans(o, landing)
    out = ST.sink_files(ST.stream_changes(ST.stream_snapshots(spark, landing, o.schema)), spark, "s3-test")
    got = spark.read.parquet(out)
    want = detect_changes(o, "p_partkey").drop("obs_seq")
    cols = ["p_partkey", "scan_date", "type", "old_value", "new_value", "change_date"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_card_finder_strategies():
    html = ('<html><body><div class="row">'
            '<div class="card"><h5 class="fw-bold">Lot 1, Jalan A, 50450 Kuala Lumpur</h5>'
            '<a class="stretched-link" href="/property/abc/x" title="Shop Office">Shop Office</a>'
            '<span>RM350,000</span><span>10 Sep 2025 (Wed)</span></div>'
            '<div class="card"><a class="stretched-link" href="/property/def/y">Condo</a>'
            '<span>RM1,200,000</span><span>11 Sep 2025 (Thu)</span><img src="/logo.png"><img data-src="/p/1.jpg"></div>'
            '</div></body></html>')
    cards = HV.cards_of_page(3, html)
    assert [c[1] for c in cards] == [0, 1] and all(c[2] == 1 for c in cards)
    assert cards[0][5] == "Lot 1, Jalan A, 50450 Kuala Lumpur"
    # no stretched link: the fallback climbs from the price text
    html2 = '<div><p>Factory, Shah Alam</p><b>RM2,000,000</b><i>1 Oct 2025 (Wed)</i></div>'
    cards2 = HV.cards_of_page(4, html2)
    assert len(cards2) == 1 and cards2[0][2] == 2


def test_card_fields_and_rejects(spark):
    html = ('<html><body><div class="row">'
            '<div class="card"><a class="stretched-link" href="/property/abc/x" title="Shop Office">Shop Office</a>'
            '<span>RM350,000</span>\n<span>10 Sep 2025 (Wed)</span>\n<span>1,200 sq.ft</span>\n<span>-20%</span></div>'
            '<div class="card"><a class="stretched-link" href="/property/def/y">Login to view</a>'
            '<span>RM9,000</span>\n<span>11 Sep 2025 (Thu)</span><img data-src="/p/1.jpg"></div>'
            '</div></body></html>')
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    f = HV.extract_card_fields(HV.split_cards(pages), "https://x.example", "https://x.example/search",
                               as_of="2025-09-11", include_expired=False).orderBy("card_index").collect()
    assert f[0]["title"] == "Shop Office" and f[0]["listing_id"] == "abc" and f[0]["size"] == "1,200 sq.ft"
    assert f[0]["discount"] == "-20%" and f[0]["reject_reason"] == "expired"
    assert f[1]["reject_reason"] == "bad_price" and f[1]["title"] == "Property Listing P7-1"
    assert f[1]["image_url"] == "https://x.example/p/1.jpg" and f[1]["listing_url"] == "https://x.example/property/def/y"
