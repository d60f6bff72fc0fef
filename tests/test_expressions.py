"""Expression tables: one row per rule or branch, expected values worked out by hand from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidscope import functions as X
from conftest import one

AS_OF = "2025-09-10"


@pytest.mark.parametrize("s,want", [
    ("  Hello   World ", "hello world"), ("\tA\nB ", "a b"), (None, ""), ("", ""),
])
def test_norm_text(spark, s, want):
    assert one(spark, X.norm_text("c"), c=s) == want


@pytest.mark.parametrize("s,want", [
    ("1,323 sq.ft", "1323sqft"), ("1,234.5 sq.ft", "12345sqft"), ("Size not specified", ""), ("900 SQFT", "900sqft"),
    ("12 x 30", "1230"), (None, ""),
])
def test_norm_size(spark, s, want):
    assert one(spark, X.norm_size("c"), c=s) == want


def test_norm_address_and_keys(spark):
    assert one(spark, X.norm_address("c"), c=" No. 1 ,Jalan  Ampang ,KL ") == "no. 1, jalan ampang, kl"
    k = one(spark, X.stable_key("t", "l", "s", "a"), t="Shop  Office", l="KL", s="1,200 sq.ft", a=None)
    assert k == "shop office|kl|1200sqft|"


def test_slug_and_hash(spark):
    assert one(spark, X.property_slug("t", "l", "s", "a"), t="Shop-Office!", l="Kuala Lumpur", s="1,200 sq.ft", a="") == \
        "shopoffice_kuala_lumpur_1200_sqft_"
    assert one(spark, X.property_slug("t", "l", "s", None, 120), t="Café  Unit", l="KL", s="") == "café_unit_kl_"
    import hashlib
    want = hashlib.md5("a_rm1_1 sep 2025 (mon)_kl_".encode()).hexdigest()
    assert one(spark, X.observation_hash("t", "p", "d", "l", "s"), t="A", p="RM1", d="1 Sep 2025 (Mon)", l="KL", s=None) == want


@pytest.mark.parametrize("s,valid,value", [
    ("RM350,000", True, 350000), ("RM350", True, 350000), ("RM49,999", False, 49999), ("RM600,000,000", False, 600000000),
    ("", False, 0), ("RM1.2.3", False, 0), ("RM 1,250,000.50", True, 1250000),
])
def test_validate_price(spark, s, valid, value):
    r = one(spark, X.validate_price("c"), c=s)
    assert (r["valid"], r["value"]) == (valid, value)


@pytest.mark.parametrize("s,incl,want", [
    ("10 Sep 2025 (Wed)", True, True), ("10 Sep 2025 (Wed)", False, True), ("9 Sep 2025 (Tue)", False, False),
    ("9 Sep 2025 (Tue)", True, True), ("Sep 10 2025", True, False), ("31 Feb 2026 (Tue)", False, False),
])
def test_validate_auction_date(spark, s, incl, want):
    assert one(spark, X.validate_auction_date("c", AS_OF, include_expired=incl), c=s) == want


@pytest.mark.parametrize("s,want", [
    ("10 Sep 2025 (Wed)", dt.date(2025, 9, 10)), ("1 Jan 2026", dt.date(2026, 1, 1)), ("31 Feb 2025", None),
    ("10 Foo 2025", None), ("", None), ("x 10 Sep 2025", None),
])
def test_parse_auction_date(spark, s, want):
    assert one(spark, X.parse_auction_date("c"), c=s) == want


def test_parse_any_date(spark):
    assert one(spark, X.parse_any_date("c"), c="10 September 2025 (Wed)") == dt.date(2025, 9, 10)
    assert one(spark, X.parse_any_date("c"), c="2025-09-10") == dt.date(2025, 9, 10)


@pytest.mark.parametrize("s,pv,allv", [
    ("RM1,234,000", 1234000, 1234000.0), ("RM 350,000.50", 350000, 350000.5), ("n/a", 0, 0.0), (None, 0, 0.0),
])
def test_price_values(spark, s, pv, allv):
    assert one(spark, X.price_value("c"), c=s) == pv
    assert one(spark, X.price_value_all("c"), c=s) == allv
    assert one(spark, X.is_valid_price("c"), c=s) == (pv >= 10000)


def test_sizes_discount_days(spark):
    assert one(spark, X.size_value("c"), c="1,323 sq.ft") == 1323
    assert one(spark, X.size_number("c"), c="1,323.5 sq.ft") == 1323.5
    assert one(spark, X.size_number("c"), c="Size not specified") is None
    assert one(spark, X.discount_value("c"), c="-25%") == 25
    assert one(spark, X.discount_value("c"), c="") == 0
    assert one(spark, X.days_until("c", AS_OF), c="12 Sep 2025 (Fri)") == 2
    assert one(spark, X.days_until("c", AS_OF), c="soon") == 999


@pytest.mark.parametrize("s,want", [
    ("Kuala Lumpur", "Kuala Lumpur"), ("Selangor [Strata]", "Selangor"), ("Selangor;", "Selangor"),
    ("Kuala Lumpur & Selangor", "Kuala Lumpur & Selangor"), ("Petaling Jaya & Others", "Petaling Jaya"),
    ("KL", "KL/Selangor"), ("Shah Alam with 2 car parks", "Shah Alam"), ("Ipoh; Perak", "Ipoh"), (None, "KL/Selangor"),
    ("Klang, ", "Klang"),
])
def test_clean_location(spark, s, want):
    assert one(spark, X.clean_location("c"), c=s) == want


@pytest.mark.parametrize("title,want", [
    ("2 Storey Terrace House", "Landed"), ("3 Storey Semi Detached House", "Landed"), ("Service Apartment", "High-rise"),
    ("Condominium [Freehold]", "High-rise"), ("Shop Office", "Commercial"), ("1.5 Storey Factory", "Industrial"),
    ("Warehouse", "Landed"),  # ends with "house": the Landed rule comes first
    ("Factory Unit", "Industrial"), ("Agricultural Land", "Land"), ("Bungalow", "Landed"), ("Residential Land", "Land"),
    ("Soho Unit", "High-rise"), ("Vacant Plot", "Land"), ("Hotel", "Commercial"), ("Something", "Commercial"),
    ("Townhouse", "Landed"), ("Residence Tower", "High-rise"), ("Link House", "Landed"),
])
def test_categorize(spark, title, want):
    assert one(spark, X.categorize_property_type("c"), c=title) == want


def test_schemes(spark):
    assert one(spark, X.scheme_from_header("c"), c="Residensi Harmoni, Kuala Lumpur") == "Residensi Harmoni"
    assert one(spark, X.scheme_from_header("c"), c="No comma") == ""
    f = X.scheme_from_address("a", "t")
    assert one(spark, f, a="Unit 3, Menara Sunway Tower, Jalan X", t="T") == "Menara Sunway Tower"
    assert one(spark, f, a="Lot 5, (Taman Indah), Jalan Y", t="T") == "Taman Indah"
    assert one(spark, f, a="No. 12, Jalan Bukit Bintang, 55100 KL", t="T") == "Jalan Bukit Bintang"
    assert one(spark, f, a="12, 34, 56", t="T") == "12"
    assert one(spark, f, a="Same", t="Same") == ""
    long = "Jalan " + "x" * 60
    assert one(spark, f, a=long + ", KL", t="T") == long[:47] + "..."
    r = X.resolve_scheme("c", "s", "h", "a", "t")
    assert one(spark, r, c="", s="Stored", h="H, KL", a="A", t="T") == "Stored"
    assert one(spark, r, c="Cached", s="Stored", h="H, KL", a="A", t="T") == "Cached"
    assert one(spark, r, c=None, s=None, h="H, KL", a="A", t="T") == "H"


def test_postcode_state_amount(spark):
    assert one(spark, X.extract_postcode("c"), c="No 1, 47301 Petaling Jaya") == "47301"
    assert one(spark, X.extract_postcode("c"), c="123456") is None
    assert one(spark, X.extract_state("c"), c="Johor Bahru, Johor") == "Johor"
    assert one(spark, X.extract_state("c"), c="Somewhere") == "Malaysia"
    assert one(spark, X.parse_amount("c"), c="500k") == 500000.0
    assert one(spark, X.parse_amount("c"), c="1.5m") == 1500000.0
    assert one(spark, X.parse_amount("c"), c="2M") == 2000000.0
    assert one(spark, X.parse_amount("c"), c="500,000") == 500000.0
    assert one(spark, X.parse_amount("c"), c="abc") is None


def test_urls_and_small_helpers(spark):
    assert one(spark, X.absolute_url("https://site.example", "h"), h="/property/abc-123") == "https://site.example/property/abc-123"
    assert one(spark, X.absolute_url("https://site.example/", "h"), h="https://o.example/x") == "https://o.example/x"
    assert one(spark, X.listing_id_from_url("h"), h="https://site.example/property/abc-123?x=1") == "abc-123"
    assert one(spark, X.listing_id_from_url("h"), h="https://site.example/search") == ""
    assert one(spark, X.strip_weekday("c"), c="10 Sep 2025 (Wed)") == "10 Sep 2025"
    assert one(spark, X.date_only("c"), c="2025-09-10T08:00:00") == "2025-09-10"
    assert one(spark, X.format_amount(F.lit(1234567))) == "RM1,234,567"


def test_days_label_and_card(spark):
    assert one(spark, X.days_label(F.lit(0), F.lit(False))) == "Today"
    assert one(spark, X.days_label(F.lit(1), F.lit(False))) == "Tomorrow"
    assert one(spark, X.days_label(F.lit(5), F.lit(False))) == "in 5d"
    assert one(spark, X.days_label(F.lit(5), F.lit(True))) == "Expired"
    card = X.alert_card(F.lit(1), "t", "l", "a", "pt", "s", "d", "p", "ad", "u")
    got = one(spark, card, t="Shop <A&B>", l="KL", a="No 1, Jalan", pt="Commercial", s="Size not specified", d="-20%",
              p="RM100,000", ad="1 Oct 2025 (Wed)", u="https://x.example/property/1")
    assert got == ("1. <b>Shop &lt;A&amp;B&gt;</b> — KL\n   📍 No 1, Jalan\n   🏷 Commercial · -20%\n   💰 RM100,000\n"
                   "   📅 1 Oct 2025 (Wed)\n   🔗 <a href=\"https://x.example/property/1\">View listing</a>\n")


def test_date_parsers_anchoring(spark):
    s = "Auction on 10 Sep 2025 (Wed)"
    assert one(spark, X.parse_auction_date("c"), c=s) is None          # Python-side B10: date must lead
    assert one(spark, X.parse_date_anywhere("c"), c=s) == dt.date(2025, 9, 10)  # dashboard B10: anywhere
    assert one(spark, X.days_until("c", AS_OF), c=s) == 0
