"""Adapter from the driver's test tables to reference-shaped listing observations (FIXTURES section 2).

The adapter only produces input rows in the observation schema; every operator applied afterwards does its
own work on them and relies on nothing about how they were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import order_sequence

# Fixed value: the query time of every fixture query.
AS_OF = "2001-10-01 00:00:00"

# Titles by p_partkey % 12 (index 11 is the placeholder family, also used for line 6).
FIXTURE_TITLES = (
    "2 Storey Terrace House",
    "3 Storey Semi Detached House",
    "Service Apartment",
    "Condominium",
    "Shop Office",
    "Retail Lot",
    "1.5 Storey Factory",
    "Warehouse",
    "Agricultural Land",
    "Office Unit",
    "Bungalow",
)
# Locations by p_partkey % 5.
FIXTURE_LOCATIONS = ("Kuala Lumpur", "Selangor [Strata]", "Selangor;", "Kuala Lumpur & Selangor", "KL")

OBS_COLUMNS = (
    "scan_date", "obs_seq", "title", "location", "size", "header_short", "header_full", "listing_id",
    "price", "auction_date", "discount", "last_updated", "price_value", "p_partkey",
)
TEXT_COLUMNS = (
    "title", "location", "size", "header_short", "header_full", "listing_id", "price", "auction_date",
    "discount", "last_updated",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`obs`: lineitem joined to part, one listing observation per line item (blank strings kept). The rows are put in order
    while they are narrow; the texts are made from the ordered rows, so that no shuffle, sample or sort holds them."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_shipdate"
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    j = j.withColumn("scan_date", F.to_date(F.date_trunc("quarter", F.col("l_shipdate"))))
    # scan_date rises with l_shipdate: named first, it spares the store's writer (one folder a scan) a second sort
    j = order_sequence(j, ["scan_date", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])

    pk = F.col("p_partkey")
    ln = F.col("l_linenumber")
    titles = F.array(*[F.lit(t) for t in FIXTURE_TITLES])
    locs = F.array(*[F.lit(x) for x in FIXTURE_LOCATIONS])
    title = F.when((ln == 6) | (pk % 12 == 11), F.concat(F.lit("Property Listing P1-"), (pk % 5).cast("string"))).otherwise(
        F.element_at(titles, (pk % 12 + 1).cast("int"))
    )
    size = F.when(pk % 10 == 0, F.lit("Size not specified")).otherwise(
        F.concat(F.format_number((F.lit(400) + F.col("p_size") * 75).cast("double"), 0), F.lit(" sq.ft"))
    )
    header_short = F.concat(
        F.lit("Residensi "), F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")), F.lit(", "),
        F.when(pk % 2 == 0, F.lit("Kuala Lumpur")).otherwise(F.lit("Selangor")),
    )
    header_full = F.when(pk % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("No. "), pk.cast("string"), F.lit(", Jalan "), F.col("p_brand"), F.lit(", "),
                 (F.lit(40000) + pk % 10000).cast("string"), F.lit(" Shah Alam, Selangor"))
    )
    listing_id = F.when((ln == 7) | (pk % 11 == 0), F.lit("")).otherwise(F.concat(F.lit("L"), (pk / 2).cast("bigint").cast("string")))
    price_value = ((pk % 40 + 1) * 250 * (F.lit(100) - (ln % 4) * 10)).cast("bigint")
    auction = F.date_format(F.date_add(F.trunc(F.col("l_shipdate"), "month"), (F.lit(30) + pk % 28).cast("int")), "d MMM yyyy (E)")
    discount = F.when(
        F.col("l_discount") >= 0.05,
        F.concat(F.lit("-"), F.round(F.col("l_discount") * 500).cast("int").cast("string"), F.lit("%")),
    ).otherwise(F.lit(""))

    return j.select(
        "scan_date",
        "obs_seq",
        title.alias("title"),
        F.element_at(locs, (pk % 5 + 1).cast("int")).alias("location"),
        size.alias("size"),
        header_short.alias("header_short"),
        header_full.alias("header_full"),
        listing_id.alias("listing_id"),
        F.concat(F.lit("RM"), F.format_number(price_value.cast("double"), 0)).alias("price"),
        auction.alias("auction_date"),
        discount.alias("discount"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"),
        price_value.alias("price_value"),
        pk.alias("p_partkey"),
    )


def blanks_to_null(df: DataFrame, cols=TEXT_COLUMNS) -> DataFrame:
    """Blank strings stand for absent keys: nullif(x, '') on the given text columns."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------------------------------------
# Rendered result pages (input of the harvest): one scan's observations drawn as cards, 12 to a page, in the
# order of the scan, plus noise cards (a repeated card, a card without price, a card without date).

FIXTURE_ROOT = "https://auctions.example"
FIXTURE_BASE = "https://auctions.example/search"
CARDS_PER_PAGE = 12


def _esc(c):
    x = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def card_html(pk, title, hs, hf, lid, price, ad, size, loc, disc):
    return F.concat(
        F.lit('<div class="col"><div class="card">\n<img src="/images/'), pk.cast("string"), F.lit('.jpg" alt="">\n'),
        F.lit('<p class="text-muted">'), _esc(hs), F.lit("</p>\n"),
        F.lit('<h5 class="fw-bold">'), _esc(hf), F.lit("</h5>\n"),
        F.lit('<a class="stretched-link" href="/property/'), F.coalesce(lid, F.lit("")), F.lit("/"), pk.cast("string"),
        F.lit('" title="'), _esc(title), F.lit('">'), _esc(title), F.lit("</a>\n"),
        F.lit("<span>"), _esc(price), F.lit("</span>\n<span>"), _esc(ad), F.lit("</span>\n<span>"), _esc(size),
        F.lit("</span>\n<span>"), _esc(loc), F.lit("</span>\n<span>"), _esc(disc), F.lit("</span>\n</div></div>\n"),
    )


def _joined(cards: DataFrame) -> DataFrame:
    """The cards of a page that follow one another in a task, joined: ``(scan_date, page0, pos, n, size, first, cards)``, ``pos`` the place
    of the first. Rows are read in the order of the scan, so that most pages are whole without being shuffled."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = ("scan_date", "page0", "pos", "size")

    def pieces(batch: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
        starts, card = np.r_[0, ends[:-1]], batch.column("card")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), card), "")
        own = {c: batch.column(c).take(pa.array(starts)) for c in keys}
        return pa.RecordBatch.from_pydict({**own, "n": pa.array(ends - starts, pa.int32()), "first": card.take(pa.array(starts)), "cards": texts})

    def join(batches):
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                scan, page, pos = (np.asarray(batch.column(c).cast(pa.int64() if c != "scan_date" else pa.int32())) for c in keys[:3])
                ends = np.flatnonzero((scan[1:] != scan[:-1]) | (page[1:] != page[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
                if len(ends):
                    yield pieces(batch, ends)
                rest = batch.slice(ends[-1] if len(ends) else 0)
        if rest is not None and rest.num_rows:
            yield pieces(rest, np.array([rest.num_rows]))

    return cards.select(*keys, "card").mapInArrow(join, "scan_date date, page0 int, pos int, size long, n int, first string, cards string")


def card_pages(obs: DataFrame) -> DataFrame:
    """(scan_date, page_id, url, html): the result pages of every scan. Cards follow the scan order; each page ends
    with a repeat of its first card and two cards the finder must ignore (no price; no date). The joined cards are stored; the page
    around them is made when it is read. Only the pages whose cards lie in several tasks are shuffled."""
    from ..operators.sequence import rank_in_group
    from ..session import stored

    r = rank_in_group(obs, "scan_date", "obs_seq", "_rank").select(
        "scan_date",
        (F.col("_rank") / CARDS_PER_PAGE).cast("int").alias("page0"),
        (F.col("_rank") % CARDS_PER_PAGE).cast("int").alias("pos"),
        F.col("group_size").alias("size"),
        card_html(F.col("p_partkey"), F.col("title"), F.col("header_short"), F.col("header_full"), F.col("listing_id"),
                  F.col("price"), F.col("auction_date"), F.col("size"), F.col("location"), F.col("discount")).alias("card"),
    )
    whole = F.col("n") == F.least(F.lit(CARDS_PER_PAGE), F.col("size") - F.col("page0").cast("long") * CARDS_PER_PAGE)
    parts = stored(_joined(r).withColumn("whole", whole), "page-parts")
    names = ("scan_date", "page0", "size", "first", "cards")
    some = parts.where("not whole").groupBy("scan_date", "page0", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "first", "cards"))).alias("_p"))
    some = some.select("scan_date", "page0", "size", F.element_at("_p", 1)["first"].alias("first"), F.array_join(F.transform("_p", lambda p: p["cards"]), "").alias("cards"))
    pages = parts.where("whole").select(*names).unionByName(some)
    n_pages = F.ceil(F.col("size") / CARDS_PER_PAGE).cast("string")
    noise = F.concat(
        F.col("first"),
        F.lit('<div class="col"><div class="card">\n<a class="stretched-link" href="/property/zz/0">No price</a>\n'
              '<span>3 Oct 2001 (Wed)</span>\n</div></div>\n'),
        F.lit('<div class="col"><div class="card">\n<a class="stretched-link" href="/property/zz/1">No date</a>\n'
              '<span>RM120,000</span>\n</div></div>\n'),
    )
    nav = F.concat(F.lit("".join(f'<a href="?page={i}">{i}</a>' for i in (1, 2)) + '<a href="?page='), n_pages, F.lit('">Last</a>'))
    html = F.concat(
        F.lit("<html><head><title>Auction results</title></head><body><p>Result(s): "),
        F.format_number(n_pages.cast("long") * CARDS_PER_PAGE, 0), F.lit('</p>\n<div class="row">\n'),
        F.col("cards"), noise,
        F.lit("</div>\n<nav>"), nav, F.lit("</nav></body></html>"),
    )
    number = (F.col("page0") + 1).cast("long")
    return pages.select("scan_date", number.alias("page_id"), F.concat(F.lit(FIXTURE_BASE + "?page="), number.cast("string")).alias("url"), html.alias("html"))


def detail_pages(obs: DataFrame) -> DataFrame:
    """(listing_url, html) detail pages for the sentinel-size cards: a labelled size, an unlabelled size or no
    size, by p_partkey % 3."""
    one = obs.filter(F.col("size") == "Size not specified").select(
        "p_partkey", "listing_id").distinct()
    n = F.format_number((F.lit(1000) + F.col("p_partkey") % 500).cast("double"), 0)
    body = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<li>Built Up : "), n, F.lit(" sq.ft</li>")))
            .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("<li>Land area "), n, F.lit(" sq ft</li>")))
            .otherwise(F.lit("<li>Tenure: Freehold</li>")))
    url = F.concat(F.lit(FIXTURE_ROOT + "/property/"), F.coalesce("listing_id", F.lit("")), F.lit("/"), F.col("p_partkey").cast("string"))
    return one.select(url.alias("listing_url"), F.concat(F.lit("<html><body><ul>"), body, F.lit("</ul></body></html>")).alias("html"))
