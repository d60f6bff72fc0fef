"""Small Column helpers used by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_str(s: str) -> Column:
    return F.lit(s)


def pystrip(c) -> Column:
    """Strip leading and trailing whitespace like Python's str.strip() (Spark's trim strips only spaces): the characters of ``\\s``, without
    a pattern, as most texts that are stripped have none of them."""
    return F.btrim(col(c), F.lit(" \t\n\x0b\f\r"))


def blank(c) -> Column:
    """True for null or ''."""
    c = col(c)
    return c.isNull() | (c == "")


def nullif_blank(c) -> Column:
    return F.nullif(col(c), F.lit(""))
