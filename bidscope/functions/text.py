"""Text normalisation, identity keys and derived text columns.

All functions map Columns to Columns with built-in Spark expressions, so they run inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import blank, col, pystrip


def norm_text(c) -> Column:
    """B1: trim, lowercase, collapse whitespace runs to one space; null -> ''."""
    c = col(c)
    return F.coalesce(F.lower(pystrip(F.regexp_replace(c, r"\s+", " "))), F.lit(""))


def norm_size(c) -> Column:
    """B2: all digit runs concatenated, then 'sqft' when the text carries 'sq.ft' or 'sqft'; null -> ''."""
    c = F.lower(col(c))
    unit = F.when(c.contains("sq.ft") | c.contains("sqft"), F.lit("sqft")).otherwise(F.lit(""))
    return F.coalesce(F.concat(F.regexp_replace(c, r"[^0-9]", ""), unit), F.lit(""))


def norm_address(c) -> Column:
    """B1 followed by one comma form ', '."""
    return F.regexp_replace(norm_text(c), r"\s*,\s*", ", ")


def stable_key(title, location, size, address, address_form: str = "text") -> Column:
    """B4: 'title|location|size|address', each part normalised (address by B1, or B3 with address_form='address')."""
    addr = norm_address(address) if address_form == "address" else norm_text(address)
    return F.concat_ws("|", norm_text(title), norm_text(location), norm_size(size), addr)


def _strip_punct(c) -> Column:
    # Unicode-aware word class, as Python's re does for str patterns.
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)[^\w\s]", "")


def property_slug(title, location, size, address=None, max_len: int | None = 150) -> Column:
    """Punctuation stripped, parts joined by '_', whitespace runs -> '_', lowercase, cut at max_len (None: whole);
    'property' where it is empty and, in the form without address, where all parts are blank. The replay shows 150
    characters with the address, the dedup 120 without it; keys use the whole slug."""
    parts = [_strip_punct(title), _strip_punct(location), _strip_punct(size)]
    if address is not None:
        parts.append(_strip_punct(address))
    base = F.lower(F.regexp_replace(pystrip(F.concat_ws("_", *parts)), r"(?U)\s+", "_"))
    empty = base == "" if address is not None else base.isin("", "__")
    return F.when(empty, F.lit("property")).otherwise(base if max_len is None else F.substring(base, 1, max_len))


def observation_hash(title, price, auction_date, location, size) -> Column:
    """md5 of lowercased 'title_price_date_location_size' (null parts as '')."""
    parts = [F.coalesce(col(x), F.lit("")) for x in (title, price, auction_date, location, size)]
    return F.md5(F.lower(F.concat_ws("_", *parts)))


DEFAULT_LOCATION = "KL/Selangor"


def clean_location(c) -> Column:
    """Cut at the first bracket, strip trailing ';', ',' and spaces, cut at ' with ', cut at '&' unless
    followed by 'Selangor', keep the part before ';'; shorter than 3 chars (or empty) -> 'KL/Selangor'."""
    c = col(c)
    x = pystrip(F.regexp_extract(c, r"^([^\[\]]*)", 1))
    x = F.regexp_replace(x, r"[;,\s]+$", "")
    x = pystrip(F.regexp_replace(x, r"(?is)\s+with\s+.*$", ""))
    x = pystrip(F.regexp_replace(x, r"(?s)\s*&\s+(?!Selangor).*$", ""))
    x = pystrip(F.regexp_replace(x, r"(?s);.*$", ""))
    return F.when(blank(c) | (F.length(x) < 3), F.lit(DEFAULT_LOCATION)).otherwise(x)


def scheme_from_header(c) -> Column:
    """Text before the last comma of the short header, trimmed; '' without a comma."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c.contains(","), pystrip(F.regexp_extract(c, r"(?s)^(.*),", 1))).otherwise(F.lit(""))


# Building words that end a named scheme in an address, and unit words that disqualify a part.
SCHEME_NAME_WORDS = (
    "Park|Centre|Point|Plaza|Place|Heights|Residences?|Tower|City|Garden|Court|Square|"
    "Perdagangan|Komersial|Damansara|Business|Mall|Complex|Kompleks"
)
UNIT_WORDS = ("Lot", "Block", "No.", "Unit", "Level", "Ground", "First", "Second")
# a part starts with a unit word when the word is followed by a word boundary (a word ending in '.' needs none)
_UNIT_START = r"(?i)^(?:" + "|".join(
    w.replace(".", r"\.") + ("" if w.endswith(".") else r"\b") for w in UNIT_WORDS) + ")"


def scheme_from_address(address, title) -> Column:
    """A capitalised name ending in a building word; else text in parentheses; else the first of the
    first three comma parts that does not start with a digit or a unit word and is longer than 5 chars
    (cut to 47 + '...' above 50); else part 0. Empty when the address is empty or equals the title."""
    a = F.coalesce(col(address), F.lit(""))
    t = col(title)
    named = pystrip(F.regexp_extract(a, r"(?:,\s*)?([A-Z][A-Za-z\s]+(?:" + SCHEME_NAME_WORDS + r")[A-Za-z\s]*)", 1))
    paren = pystrip(F.regexp_extract(a, r"\(([^)]+)\)", 1))
    parts = F.slice(F.transform(F.split(a, ","), lambda s: pystrip(s)), 1, 3)
    good = F.filter(
        parts,
        lambda s: (s != "")
        & ~s.rlike(r"^\d")
        & ~s.rlike(_UNIT_START)
        & (F.length(s) > 5),
    )
    first_good = F.try_element_at(good, F.lit(1))
    cut = F.when(F.length(first_good) > 50, F.concat(F.substring(first_good, 1, 47), F.lit("..."))).otherwise(first_good)
    part0 = pystrip(F.try_element_at(F.split(a, ","), F.lit(1)))
    derived = F.coalesce(F.nullif(named, F.lit("")), F.nullif(paren, F.lit("")), cut, part0, F.lit(""))
    return F.when((a == "") | (a == F.coalesce(t, F.lit(""))), F.lit("")).otherwise(derived)


def resolve_scheme(cached, stored, header_short, address, title) -> Column:
    """Cached scheme -> stored scheme -> B19 of the short header -> B20 of the address."""
    return F.coalesce(
        F.nullif(col(cached), F.lit("")),
        F.nullif(col(stored), F.lit("")),
        F.nullif(scheme_from_header(header_short), F.lit("")),
        F.nullif(scheme_from_address(address, title), F.lit("")),
        F.lit(""),
    )


def search_text(*cols) -> Column:
    """Lowercase space-join of the given columns (null parts as ''), matched later with contains()."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in cols]))


def listing_search_text(title="title", address="address", location="location", ptype="property_type",
                        price="price", size="size") -> Column:
    """B24, dashboard variant: title, address, location, type, price, size."""
    return search_text(title, address, location, ptype, price, size)


def chat_search_text(title="title", location="location", ptype="property_type", size="size",
                     scheme="scheme_name") -> Column:
    """B24, chat variant: title, location, type, size, scheme."""
    return search_text(title, location, ptype, size, scheme)


__all__ = [
    "norm_text", "norm_size", "norm_address", "stable_key", "property_slug", "observation_hash",
    "clean_location", "scheme_from_header", "scheme_from_address", "resolve_scheme", "search_text",
    "listing_search_text", "chat_search_text", "DEFAULT_LOCATION",
]
