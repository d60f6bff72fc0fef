"""Display labels and alert cards (B18, B29) as Spark string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

SIZE_SENTINEL = "Size not specified"


def days_label(days, expired) -> Column:
    """B18: 'Expired' / 'Today' (<= 0) / 'Tomorrow' / 'in Nd'."""
    d = col(days)
    return (
        F.when(F.coalesce(col(expired), F.lit(False)), F.lit("Expired"))
        .when(d <= 0, F.lit("Today"))
        .when(d == 1, F.lit("Tomorrow"))
        .otherwise(F.concat(F.lit("in "), d.cast("string"), F.lit("d")))
    )


def is_urgent(days) -> Column:
    """Urgent when the auction is at most 7 days away."""
    return col(days) <= 7


def html_escape(c) -> Column:
    """HTML escaping with quotes (&, <, >, ", ')."""
    x = F.coalesce(col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _nonblank(c) -> Column:
    return F.coalesce(col(c), F.lit("")) != ""


def alert_card(index, title, location, address, ptype, size, discount, price, auction_date, url,
               old_price=None, new_price=None, old_date=None, new_date=None) -> Column:
    """One text card per listing (price + date lines) or per change (old -> new lines), HTML-escaped.

    Lines: '{i}. <b>title</b> — loc', address, 'type · size · discount' (sentinel size left out),
    price / auction lines or change lines, link."""
    e = html_escape
    head = F.concat(col(index).cast("string"), F.lit(". <b>"), e(F.coalesce(col(title), F.lit("Untitled"))), F.lit("</b>"),
                    F.when(_nonblank(location), F.concat(F.lit(" — "), e(location))).otherwise(F.lit("")))
    addr = F.when(_nonblank(address), F.concat(F.lit("   📍 "), e(address)))
    meta_parts = F.array_compact(F.array(
        F.when(_nonblank(ptype), e(ptype)),
        F.when(_nonblank(size) & (col(size) != SIZE_SENTINEL), e(size)),
        F.when(_nonblank(discount), e(discount)),
    ))
    meta = F.when(F.size(meta_parts) > 0, F.concat(F.lit("   🏷 "), F.array_join(meta_parts, " · ")))
    if old_price is not None:
        price_line = F.when(col(old_price).isNotNull() | col(new_price).isNotNull(),
                            F.concat(F.lit("   💰 <s>"), e(old_price), F.lit("</s> → <b>"), e(new_price), F.lit("</b>")))
        date_line = F.when(col(old_date).isNotNull() | col(new_date).isNotNull(),
                           F.concat(F.lit("   📅 <s>"), e(old_date), F.lit("</s> → <b>"), e(new_date), F.lit("</b>")))
    else:
        price_line = F.when(_nonblank(price), F.concat(F.lit("   💰 "), e(price)))
        date_line = F.when(_nonblank(auction_date), F.concat(F.lit("   📅 "), e(auction_date)))
    link = F.when(_nonblank(url), F.concat(F.lit('   🔗 <a href="'), e(url), F.lit('">View listing</a>')))
    return F.concat(F.concat_ws("\n", head, addr, meta, price_line, date_line, link), F.lit("\n"))
