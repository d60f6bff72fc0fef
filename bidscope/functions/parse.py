"""Parsing and validation of display strings into typed values (B7, B8, B10-B13, B15-B17, B22, B23, B25,
B27, B28, B30). ANSI mode stays on, so every conversion uses try_cast / try_to_date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, pystrip

# Price gate of the harvest validator (RM).
MIN_PRICE = 50_000
MAX_PRICE = 500_000_000
# Fixed value: a listing price is considered real from RM10,000 on (publish side).
VALID_PRICE_FLOOR = 10_000


def _as_of_date(as_of) -> Column:
    return F.to_date(F.lit(as_of)) if isinstance(as_of, str) else F.to_date(as_of)


def validate_price(c) -> Column:
    """struct(valid, value). Keep digits and dots; empty or unparsable -> (false, 0); below 1000 the
    value is read as thousands; valid within [50,000, 500,000,000]; value truncated to an integer."""
    cleaned = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^0-9.]", "")
    num = cleaned.try_cast("double")
    scaled = F.when(num < 1000, num * 1000).otherwise(num)
    ok = num.isNotNull() & (scaled >= MIN_PRICE) & (scaled <= MAX_PRICE)
    value = F.when(num.isNull(), F.lit(0)).otherwise(scaled.cast("bigint"))
    return F.struct(F.coalesce(ok, F.lit(False)).alias("valid"), value.alias("value"))


# Fixed value: the form of an auction date; the patterns inside the functions below are likewise forms of the texts that are read.
AUCTION_DATE_PATTERN = r"^\d{1,2}\s+\w{3}\s+\d{4}\s+\(\w{3}\)"


def validate_auction_date(c, as_of=None, include_expired: bool = True) -> Column:
    """The text must start with 'd Mon yyyy (Www)'. With include_expired any such text passes; otherwise
    the date without the weekday must parse as 'd Mon yyyy' and be on or after the as_of date."""
    c = F.coalesce(col(c), F.lit(""))
    shaped = c.rlike(AUCTION_DATE_PATTERN)
    if include_expired:
        return shaped
    no_day = pystrip(F.regexp_replace(c, r"\s*\(\w{3}\)", ""))
    d = F.try_to_date(no_day, "d MMM yyyy")
    return shaped & F.coalesce(d >= _as_of_date(as_of), F.lit(False))


def _day_month_year(c, pattern: str) -> Column:
    """The date that the first match of ``pattern`` spells as day, month and year; null where nothing matches or it is no date."""
    found = F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, 0)
    return F.try_to_date(F.regexp_replace(found, r"\s+", " "), "d MMM yyyy")


def parse_auction_date(c) -> Column:
    """Leading 'd Mon yyyy' -> date, else null (unknown month or impossible day -> null)."""
    return _day_month_year(c, r"^\d{1,2}\s+\w{3}\s+\d{4}")


def parse_date_anywhere(c) -> Column:
    """B10, dashboard variant: the first 'd Mon yyyy' anywhere in the text -> date (unknown month -> null, Q18)."""
    return _day_month_year(c, r"\d{1,2}\s+\w{3}\s+\d{4}")


def parse_any_date(c) -> Column:
    """B10, dedup variant: parenthesised parts removed, then 'd Mon yyyy', 'd Month yyyy' or ISO 'yyyy-MM-dd'."""
    s = pystrip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s*\(.*?\)\s*", " "))
    return F.coalesce(
        F.try_to_date(s, "d MMM yyyy"),
        F.try_to_date(s, "d MMMM yyyy"),
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d")),
    )


def price_value(c) -> Column:
    """First run of digits and commas as an integer, else 0."""
    run = F.replace(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"[\d,]+", 0), F.lit(","), F.lit(""))
    return F.coalesce(run.try_cast("bigint"), F.lit(0).cast("bigint"))


def price_value_all(c) -> Column:
    """All digits and dots of the text as a double, else 0."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^0-9.]", "")
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def is_valid_price(c) -> Column:
    """B11 >= 10,000."""
    return price_value(c) >= VALID_PRICE_FLOOR


def size_value(c) -> Column:
    """B15, sort variant: first run of digits and commas as an integer, else 0."""
    return price_value(c)


def size_number(c) -> Column:
    """B15, range-filter variant: commas removed, first run of digits and dots as a double; null when none."""
    s = F.replace(F.coalesce(col(c), F.lit("")), F.lit(","), F.lit(""))
    return F.regexp_extract(s, r"([0-9.]+)", 1).try_cast("double")


def discount_value(c) -> Column:
    """B16: '-N%' -> N, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"-(\d+)", 1).try_cast("int"), F.lit(0))


def days_until(c, as_of) -> Column:
    """Whole days from the as_of day to the auction day (unanchored 'd Mon yyyy'); unparsable -> 999."""
    return F.coalesce(F.datediff(parse_date_anywhere(c), _as_of_date(as_of)), F.lit(999))


def extract_postcode(c) -> Column:
    """First standalone 5-digit number, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\b(\d{5})\b", 1), F.lit(""))


# State names searched in this order; the first one contained in the address wins.
STATES = (
    "Kuala Lumpur", "Selangor", "Johor", "Penang", "Perak", "Kedah",
    "Kelantan", "Terengganu", "Pahang", "Negeri Sembilan",
    "Melaka", "Sabah", "Sarawak", "Putrajaya", "Labuan",
)
COUNTRY_FALLBACK = "Malaysia"


def extract_state(c) -> Column:
    """First state (in list order) contained case-insensitively in the address, else 'Malaysia'."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    expr = None
    for st in STATES:
        cond = low.contains(st.lower())
        expr = F.when(cond, F.lit(st)) if expr is None else expr.when(cond, F.lit(st))
    return expr.otherwise(F.lit(COUNTRY_FALLBACK))


def parse_amount(c) -> Column:
    """B25: '500k', '1.5m', '500,000', 'RM 2M' -> number (k = thousand, m = million, case-insensitive); else null."""
    s = F.lower(F.translate(F.coalesce(col(c), F.lit("")), ", \t\n\x0b\f\r", ""))
    num = F.regexp_extract(s, r"^(?:rm)?([0-9]+(?:\.[0-9]+)?)[km]?$", 1).try_cast("double")  # null where the text is no amount
    return num * F.when(s.endswith("k"), F.lit(1_000.0)).when(s.endswith("m"), F.lit(1_000_000.0)).otherwise(F.lit(1.0))


def absolute_url(root: str, href) -> Column:
    """Keep absolute links; '/x' -> root + '/x'; other relative links -> root + '/' + link."""
    h = F.coalesce(col(href), F.lit(""))
    r = root.rstrip("/")
    return (
        F.when(h.rlike(r"^https?://"), h)
        .when(h.startswith("/"), F.concat(F.lit(r), h))
        .when(h == "", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(r + "/"), h))
    )


def listing_id_from_url(url) -> Column:
    """The path segment after '/property/' ('' when absent)."""
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"/property/([^/?#]+)", 1)


def date_only(c) -> Column:
    """First 10 characters (the ISO date of a timestamp string)."""
    return F.substring(F.coalesce(col(c), F.lit("")), 1, 10)


def strip_weekday(c) -> Column:
    """Text before the first ' (' (weekday in parentheses), trimmed."""
    return pystrip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)\s*\(.*$", ""))


def short_address(c, n: int = 120) -> Column:
    """First 120 characters of the full address."""
    return F.substring(F.coalesce(col(c), F.lit("")), 1, n)


def round_coord(c) -> Column:
    """Coordinates rounded to 5 decimals."""
    return F.round(col(c), 5)


def format_amount(c) -> Column:
    """B30: 'RM' + thousands separators, no decimals."""
    return F.concat(F.lit("RM"), F.format_number(col(c).cast("double"), 0))
