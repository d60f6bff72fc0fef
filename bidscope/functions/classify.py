"""Property type from the listing title (B9) and the chat type aliases (C11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, pystrip

# Ordered (type, pattern) rules on the lowercased title with bracketed parts removed.
# The first rule that matches decides; order is the semantics. A third field is a word that must be absent.
TYPE_RULES = (
    ("Landed", r"(semi.?detached|detached)\s*(house|home|plot|lot)"),
    ("Landed", r"bungalow"),
    ("Landed", r"terrace\s*house"),
    ("Landed", r"cluster\s*(semi|house|design)"),
    ("Landed", r"link\s*(semi|house|bungalow)"),
    ("Landed", r"town\s*(house|villa)"),
    ("Landed", r"villa\b"),
    ("Landed", r"\d+\.?\d*\s*storey\s*(semi|detached|cluster|link|zero)"),
    ("Landed", r"houses?$"),
    ("Landed", r"(detached|semi|terrace|house|bungalow)\s*(plot|lot)\b"),
    ("Landed", r"residential\s*(lot|plot|building|terrace)"),
    ("Landed", r"vacant\s*(semi|detached|residential|terrace)"),
    ("Landed", r"housing\s*(lot|plot|land)"),
    ("High-rise", r"apartment|condominium|condo\b|flat\b|penthouse|service\s+suite"),
    ("High-rise", r"\bsoho\b"),
    ("High-rise", r"residence\b", "land"),
    ("High-rise", r"resid(ential|ence)", "land"),
    ("Industrial", r"factory|warehouse|industrial"),
    ("Land", r"\bland\b"),
    ("Land", r"vacant\s*(plot|lot|building)"),
    ("Land", r"parcels?\s+of"),
    ("Land", r"residential\s*land"),
    ("Commercial", r"shop"),
    ("Commercial", r"office|sofo|sovo|business\s*(suite|centre|center)"),
    ("Commercial", r"retail"),
    ("Commercial", r"hotel"),
    ("Commercial", r"commercial"),
    ("Commercial", r"(mall|plaza|complex|square|kiosk)\b"),
    ("Commercial", r"strata|stratified"),
    ("Commercial", r"convention\s*hall"),
)
DEFAULT_TYPE = "Commercial"
PROPERTY_TYPES = ("Landed", "High-rise", "Industrial", "Land", "Commercial")


def type_title_text(title) -> Column:
    """Lowercased title with every '[...]' part removed and outer whitespace stripped."""
    return F.lower(pystrip(F.regexp_replace(F.coalesce(col(title), F.lit("")), r"(?s)\[.*?\]", "")))


def categorize_property_type(title) -> Column:
    """One when-chain over the ordered rules; default Commercial."""
    t = F.regexp_replace(type_title_text(title), r"\s+$", "")
    expr = None
    for ptype, pattern, *absent in TYPE_RULES:
        cond = t.rlike(pattern)
        for word in absent:
            cond &= ~t.contains(word)
        expr = F.when(cond, F.lit(ptype)) if expr is None else expr.when(cond, F.lit(ptype))
    return expr.otherwise(F.lit(DEFAULT_TYPE))


# Chat type words and the type each one searches for. The reference maps them to an older
# vocabulary; we map them onto the five current types (decision Q10).
TYPE_ALIASES = {
    "factory": "Industrial",
    "warehouse": "Industrial",
    "industrial": "Industrial",
    "shop": "Commercial",
    "office": "Commercial",
    "retail": "Commercial",
    "hotel": "Commercial",
    "resort": "Commercial",
    "commercial": "Commercial",
    "land": "Land",
    "semid": "Landed",
    "semi-d": "Landed",
    "bungalow": "Landed",
    "villa": "Landed",
    "landed": "Landed",
    "condo": "High-rise",
    "apartment": "High-rise",
    "high-rise": "High-rise",
    "highrise": "High-rise",
}


def resolve_type_alias(word: str) -> str:
    """C11 helper: chat word -> type name (unknown words are searched as given)."""
    return TYPE_ALIASES.get(word.strip().lower(), word.strip())
