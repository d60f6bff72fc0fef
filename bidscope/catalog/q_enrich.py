"""Catalog: enrichment through caches and a gazetteer, scheme batches and answers, market answers, saved
filters (D6-D9, D12, E9, H3, I5-I7, B26, C13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import STATES
from ..operators import enrich as EN
from ..operators import filters as FL
from ..operators import predicates as P
from ..operators import rank as R
from ..operators import spatial as SP
from ..plans.dedup import rank_within
from ..session import stored
from . import context as C
from .registry import register
from .sqlviews import register_published, sql_is_expired, view

register_published()

# --- SQL twins of the side tables ------------------------------------------------------------------------
_PC = "coalesce(TRY_CAST(nullif(regexp_extract(address, '\\b(\\d{5})\\b', 1), '') AS INTEGER), 0)"
_STATE_SQL = ("CASE " + " ".join(f"WHEN contains(lower(address), '{s.lower()}') THEN '{s}'" for s in STATES) + " ELSE 'Malaysia' END")


def _addr_sql(max_pc: int) -> str:
    return (f"SELECT * FROM (SELECT DISTINCT trim(coalesce(header_full, '')) AS address FROM state "
            f"WHERE length(trim(coalesce(header_full, ''))) > 5) x WHERE {_PC} BETWEEN 1 AND {max_pc}")


view("geo_cache", f"""
SELECT address, 3.0 + ({_PC} % 100) / 1000.0 AS lat, 101.0 + ({_PC} % 700) / 1000.0 AS lng,
       ['full', 'postcode', 'state', 'default'][{_PC} % 4 + 1] AS q
FROM ({_addr_sql(41000)}) a""", ("state",))

view("gaz", f"""
SELECT 'full' AS kind, address AS key, 3.5 + ({_PC} % 100) / 1000.0 AS lat, 101.5 + ({_PC} % 700) / 1000.0 AS lng
FROM ({_addr_sql(41300)}) a
UNION ALL
SELECT DISTINCT 'postcode', nullif(regexp_extract(address, '\\b(\\d{{5}})\\b', 1), '') || ', ' || {_STATE_SQL},
       2.5 + ({_PC} % 100) / 1000.0, 102.0 + ({_PC} % 700) / 1000.0
FROM ({_addr_sql(41600)}) b WHERE nullif(regexp_extract(address, '\\b(\\d{{5}})\\b', 1), '') IS NOT NULL
UNION ALL
SELECT 'state', s, 1.0 + (i - 1) / 10.0, 100.0 + (i - 1) / 10.0
FROM (SELECT unnest([{', '.join(repr(s) for s in STATES)}]) AS s, generate_subscripts([{', '.join(repr(s) for s in STATES)}], 1) AS i) t
""", ("state",))

view("scheme_cache_v", f"""
SELECT address, CASE WHEN TRY_CAST(regexp_extract(address, 'Brand#(\\d+)', 1) AS INTEGER) % 2 = 1
                     THEN 'Taman ' || regexp_extract(address, 'Brand#(\\d+)', 1) ELSE '' END AS scheme
FROM ({_addr_sql(41000)}) a""", ("state",))

view("geo_cand", f"""
SELECT DISTINCT trim(coalesce(header_full, '')) AS address FROM statet
WHERE NOT {sql_is_expired()} AND length(trim(coalesce(header_full, ''))) > 5""", ("statet",))

view("scheme_cand", f"""
SELECT address, arg_max(title, first_obs_seq) AS title FROM (
  SELECT trim(coalesce(header_full, '')) AS address, title, first_obs_seq FROM statet WHERE NOT {sql_is_expired()}) s
WHERE address <> '' AND coalesce(title, '') <> '' GROUP BY address""", ("statet",))

view("scheme_num", """
SELECT address, title, (idx - 1) // 50 AS batch_id, CAST((idx - 1) % 50 + 1 AS INTEGER) AS pos FROM (
  SELECT *, row_number() OVER (ORDER BY address) AS idx FROM (
    SELECT * FROM scheme_cand WHERE address NOT IN (SELECT address FROM scheme_cache_v)) u) n""", ("scheme_cand", "scheme_cache_v"))

view("scheme_batches", """
SELECT batch_id, count(*) AS n_titles, string_agg(CAST(pos AS VARCHAR) || '. ' || title, chr(10) ORDER BY pos) AS request_text
FROM scheme_num GROUP BY batch_id""", ("scheme_num",))


# --- queries ---------------------------------------------------------------------------------------------


def _geo_candidates(spark, sf_dir):
    return P.geocode_candidates(C.state(spark, sf_dir), C.AS_OF)


@register("d8_h3_uncached_addresses", "D8, H3, C16", views=("geo_cand", "geo_cache"), sql="""
SELECT address FROM geo_cand WHERE address NOT IN (SELECT address FROM geo_cache)""")
def d8_h3_uncached_addresses(spark, sf_dir):
    return EN.uncached(_geo_candidates(spark, sf_dir), C.geocode_cache(spark, sf_dir))


@register("d9_geocode_gazetteer", "D9, B22, B23", views=("geo_cand", "geo_cache", "gaz"), sql=f"""
WITH u AS (SELECT address FROM geo_cand WHERE address NOT IN (SELECT address FROM geo_cache)),
a AS (SELECT address, nullif(regexp_extract(address, '\\b(\\d{{5}})\\b', 1), '') AS pc, {_STATE_SQL} AS st FROM u),
g AS (SELECT kind, key, first(lat) AS lat, first(lng) AS lng FROM gaz GROUP BY 1, 2)
SELECT a.address,
       CASE WHEN f.key IS NOT NULL THEN f.lat WHEN a.pc IS NOT NULL AND p.key IS NOT NULL THEN p.lat
            WHEN s.key IS NOT NULL THEN s.lat ELSE 3.1390 END AS lat,
       CASE WHEN f.key IS NOT NULL THEN f.lng WHEN a.pc IS NOT NULL AND p.key IS NOT NULL THEN p.lng
            WHEN s.key IS NOT NULL THEN s.lng ELSE 101.6869 END AS lng,
       CASE WHEN f.key IS NOT NULL THEN 'full' WHEN a.pc IS NOT NULL AND p.key IS NOT NULL THEN 'postcode'
            WHEN s.key IS NOT NULL THEN 'state' ELSE 'default' END AS q
FROM a LEFT JOIN (SELECT * FROM g WHERE kind = 'full') f ON f.key = a.address
LEFT JOIN (SELECT * FROM g WHERE kind = 'postcode') p ON p.key = concat_ws(', ', a.pc, a.st)
LEFT JOIN (SELECT * FROM g WHERE kind = 'state') s ON s.key = a.st""")
def d9_geocode_gazetteer(spark, sf_dir):
    u = EN.uncached(_geo_candidates(spark, sf_dir), C.geocode_cache(spark, sf_dir))
    return EN.geocode_by_gazetteer(u, C.gazetteer(spark, sf_dir))


@register("d6_d7_attach_caches", "D6, D7, B21, B28, A6", views=("published", "geo_cache", "scheme_cache_v", "statet"), sql="""
SELECT p.p_partkey,
       CASE WHEN g.q IS NOT NULL AND g.q <> 'default' THEN round(g.lat, 5) END AS lat,
       CASE WHEN g.q IS NOT NULL AND g.q <> 'default' THEN round(g.lng, 5) END AS lng,
       coalesce(nullif(sc.scheme, ''), nullif(p.scheme_name, ''), '') AS scheme_name
FROM published p JOIN statet s ON s.p_partkey = p.p_partkey
LEFT JOIN geo_cache g ON g.address = trim(coalesce(s.header_full, ''))
LEFT JOIN scheme_cache_v sc ON sc.address = trim(coalesce(s.header_full, ''))""")
def d6_d7_attach_caches(spark, sf_dir):
    pub = C.publish(spark, sf_dir, C.geocode_cache(spark, sf_dir), C.scheme_cache(spark, sf_dir))
    return pub.select("p_partkey", "lat", "lng", "scheme_name")


@register("c13_in_bounds", "C13, D6", views=("published", "geo_cache", "statet"), sql="""
SELECT p.p_partkey FROM published p JOIN statet s ON s.p_partkey = p.p_partkey
JOIN geo_cache g ON g.address = trim(coalesce(s.header_full, ''))
WHERE g.q <> 'default' AND round(g.lat, 5) BETWEEN 3.02 AND 3.06 AND round(g.lng, 5) BETWEEN 101.1 AND 101.4""")
def c13_in_bounds(spark, sf_dir):
    pub = C.publish(spark, sf_dir, C.geocode_cache(spark, sf_dir), None)
    return P.in_bounds(pub, 3.02, 101.1, 3.06, 101.4).select("p_partkey")


@register("c13_in_bounds_by_cell", "C13 (Z-order layout), D6", views=("published", "geo_cache", "statet"), sql="""
SELECT p.p_partkey, round(g.lat, 5) AS lat, round(g.lng, 5) AS lng FROM published p JOIN statet s ON s.p_partkey = p.p_partkey
JOIN geo_cache g ON g.address = trim(coalesce(s.header_full, ''))
WHERE g.q <> 'default' AND round(g.lat, 5) BETWEEN 3.01 AND 3.05 AND round(g.lng, 5) BETWEEN 101.2 AND 101.5""")
def c13_in_bounds_by_cell(spark, sf_dir):
    key = (spark.sparkContext.applicationId, "by_cell:" + sf_dir)
    path = C._MATERIALISED.get(key)
    if path is None:
        path = C._MATERIALISED[key] = C.scratch_path(spark, "by-cell")
        SP.write_by_cell(C.publish(spark, sf_dir, C.geocode_cache(spark, sf_dir), None), path)
    return SP.boxed(spark.read.parquet(path), 3.01, 101.2, 3.05, 101.5).select("p_partkey", "lat", "lng")


@register("e9_cache_coverage", "E9", views=("geo_cache", "scheme_cache_v"), sql="""
SELECT 'geocode' AS cache, q AS bucket, count(*) AS n FROM geo_cache GROUP BY 2
UNION ALL
SELECT 'scheme', CASE WHEN scheme <> '' THEN 'named' ELSE 'unnamed' END, count(*) FROM scheme_cache_v GROUP BY 2""")
def e9_cache_coverage(spark, sf_dir):
    g = EN.geocode_quality(C.geocode_cache(spark, sf_dir)).select(F.lit("geocode").alias("cache"), F.col("q").alias("bucket"), "n")
    s = EN.scheme_coverage(C.scheme_cache(spark, sf_dir)).select(F.lit("scheme").alias("cache"), F.col("kind").alias("bucket"), "n")
    return g.unionByName(s)


def _scheme_batches(spark, sf_dir):
    cands = P.scheme_candidates(C.state(spark, sf_dir), C.AS_OF, order=("first_obs_seq",))
    todo = EN.uncached(cands, C.scheme_cache(spark, sf_dir))
    return EN.scheme_request_batches(todo)


@register("i5_scheme_batches", "I5, C16, D8", views=("scheme_batches",), sql="SELECT batch_id, n_titles, request_text FROM scheme_batches")
def i5_scheme_batches(spark, sf_dir):
    _, batches = _scheme_batches(spark, sf_dir)
    return batches


_ANSWERS_SQL = """
WITH r AS (
  SELECT batch_id, n_titles, regexp_split_to_array(request_text, '\\n') AS lines FROM scheme_batches),
names AS (
  SELECT batch_id, n_titles,
         list_transform(lines, lambda l: CASE WHEN starts_with(regexp_replace(l, '^\\d+\\.\\s', ''), 'Property Listing') THEN 'NONE'
                                       ELSE split_part(regexp_replace(l, '^\\d+\\.\\s', ''), ' ', 1) || ' Residences' END) AS nm
  FROM r),
resp AS (
  SELECT batch_id, n_titles, CASE WHEN batch_id % 5 = 4 THEN nm[1:len(nm) - 1] ELSE nm END AS arr FROM names),
ok AS (SELECT batch_id, unnest(arr) AS v, generate_subscripts(arr, 1) AS pos FROM resp WHERE len(arr) = n_titles)
SELECT n.address, CASE WHEN ok.v IS NOT NULL AND ok.v <> 'NONE' THEN ok.v ELSE '' END AS scheme
FROM scheme_num n LEFT JOIN ok ON ok.batch_id = n.batch_id AND ok.pos = n.pos"""


@register("i6_scheme_answers", "I6", views=("scheme_batches", "scheme_num"), sql=_ANSWERS_SQL)
def i6_scheme_answers(spark, sf_dir):
    numbered, batches = _scheme_batches(spark, sf_dir)
    return EN.apply_scheme_responses(numbered, batches, C.scheme_responses(batches))


@register("i6_cache_write_back", "I6, D7", views=("scheme_batches", "scheme_num", "scheme_cache_v"), sql=f"""
SELECT address, scheme FROM scheme_cache_v
UNION ALL
SELECT address, scheme FROM ({_ANSWERS_SQL}) a WHERE address NOT IN (SELECT address FROM scheme_cache_v)""")
def i6_cache_write_back(spark, sf_dir):
    """The cache as it is after a run of requests, written and read back."""
    numbered, batches = _scheme_batches(spark, sf_dir)
    answers = EN.apply_scheme_responses(numbered, batches, C.scheme_responses(batches))
    return stored(EN.merge_cache(C.scheme_cache(spark, sf_dir), answers), "scheme_cache")


ANSWER_ROWS = 10


def _market_answers(spark, sf_dir):
    """Answer texts for all listings of each scheme, ANSWER_ROWS listings an answer: active listings as sale listings
    and expired ones as rentals (fixture stand-in for the model's answers), fenced for every other scheme and
    preceded by a sentence for every third one."""
    pub = C.published(spark, sf_dir).filter(F.col("scheme_name") != "")
    item = F.struct(F.col("title"), F.col("price"), F.lit(None).cast("string").alias("psf"), F.col("size"),
                    F.lit(None).cast("string").alias("beds"), F.col("image_url").alias("image"), F.col("listing_url").alias("url"))
    ranked = rank_within(pub, "scheme_name", ["arrival"], "rank")
    number = F.floor((F.col("rank") - 1) / ANSWER_ROWS).cast("string")
    g = ranked.groupBy("scheme_name", F.concat(F.col("scheme_name"), F.lit("#"), number).alias("answer_id")).agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_expired"), F.struct(F.col("rank"), item.alias("i"))))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("is_expired"), F.struct(F.col("rank"), item.alias("i"))))).alias("r"),
        F.count(F.lit(1)).alias("n"))
    doc = F.to_json(F.struct(F.transform("s", lambda x: x["i"]).alias("sale_listings"),
                             F.transform("r", lambda x: x["i"]).alias("rental_listings"),
                             F.concat(F.lit("Observed "), F.col("n").cast("string"), F.lit(" listings.")).alias("summary")))
    k = F.abs(F.xxhash64("scheme_name"))
    text = (F.when(k % 3 == 0, F.concat(F.lit("Here is the data: "), doc, F.lit(" Thanks.")))
            .when(k % 2 == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).otherwise(doc))
    return g.select("answer_id", text.alias("answer_text"))


@register("i7_market_listings", "I7", views=("published",), sql="""
SELECT answer_id, CASE WHEN is_expired THEN 'rental' ELSE 'sale' END AS kind,
       row_number() OVER (PARTITION BY answer_id, is_expired ORDER BY arrival) AS pos,
       title, price, CAST(NULL AS VARCHAR) AS psf, size, CAST(NULL AS VARCHAR) AS beds, image_url AS image, listing_url AS url
FROM (SELECT *, scheme_name || '#' || CAST((row_number() OVER (PARTITION BY scheme_name ORDER BY arrival) - 1) // 10 AS VARCHAR) AS answer_id
      FROM published WHERE scheme_name <> '') t""")
def i7_market_listings(spark, sf_dir):
    rows, _ = EN.market_listings(_market_answers(spark, sf_dir))
    return rows.select("answer_id", "kind", F.col("pos").cast("bigint").alias("pos"), "title", "price", "psf", "size", "beds", "image", "url")


# --- saved filters -----------------------------------------------------------------------------------------
# Saved filter texts as a user types them.
SAVED_FILTER_TEXTS = (
    "landed in kuala lumpur under 500k",
    "condo selangor 200k to 400k",
    "shop office above 1m",
    "factory shah alam",
    "warehouse below rm 300,000",
    "land kl max 250k",
    "terrace house 3-5",
    "bungalow from 800k",
    "apartment brand 12",
    "commercial petaling jaya",
    "retail lot kl/selangor budget 150k",
    "cheap office unit",
)


def _saved(spark, sf_dir):
    """Saved filters: the fixed texts above (ids 1..12) plus one per scheme of the published listings,
    '<scheme> under <largest price of the scheme, in k>k' (ids 1000 + rank of the scheme name)."""
    from ..operators.sequence import dense_index

    fixed = spark.createDataFrame(list(enumerate(SAVED_FILTER_TEXTS, 1)), "filter_id long, text string")
    per = (C.published(spark, sf_dir).filter(F.col("scheme_name") != "")
           .groupBy("scheme_name").agg(F.max("price_value").alias("_mx")))
    per = dense_index(per, ["scheme_name"], "_i").select(
        (F.lit(1000) + F.col("_i")).cast("long").alias("filter_id"),
        F.concat(F.lower("scheme_name"), F.lit(" under "), (F.col("_mx") / 1000).cast("long").cast("string"), F.lit("k")).alias("text"))
    return fixed.unionByName(per)


def _sql_parse() -> str:
    q = "lower(trim(text))"
    tw = sorted(FL.FILTER_TYPE_WORDS, key=len, reverse=True)
    esc = FL._re_escape
    typ = "CASE " + " ".join(
        f"WHEN regexp_matches({q}, '(^|[^a-z0-9]){esc(k)}($|[^a-z0-9])') THEN '{FL.FILTER_TYPE_WORDS[k]}'" for k in tw) + " END"
    rr, ur, orr = FL.RANGE_RE, FL.UNDER_RE, FL.OVER_RE

    def amt(num, unit):
        return (f"(TRY_CAST(nullif(regexp_extract(replace({num}, ',', ''), '^(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) * "
                f"CASE lower({unit}) WHEN 'k' THEN 1000.0 WHEN 'm' THEN 1000000.0 ELSE 1.0 END)")
    g = lambda rx, i: f"regexp_extract({q}, '{rx}', {i})"
    is_range = (f"({g(rr, 0)} <> '' AND ({g(rr, 2)} <> '' OR {g(rr, 4)} <> '' OR contains({g(rr, 0)}, 'rm') "
                f"OR length(regexp_replace({g(rr, 1)}, '[^0-9]', '', 'g')) >= 4 OR length(regexp_replace({g(rr, 3)}, '[^0-9]', '', 'g')) >= 4))")
    under = f"CASE WHEN {g(ur, 0)} <> '' THEN {amt(g(ur, 1), g(ur, 2))} END"
    over = f"CASE WHEN {g(orr, 0)} <> '' THEN {amt(g(orr, 1), g(orr, 2))} END"
    places = FL._ordered_places()
    shown = lambda p: "Kuala Lumpur" if p == "kl" else " ".join(w[:1].upper() + w[1:] for w in p.split(" "))
    loc = "CASE " + " ".join(f"WHEN contains({q}, '{p}') THEN '{shown(p)}'" for p in places) + " END"
    city = "CASE " + " ".join(
        f"WHEN contains({q}, '{p}') THEN {'NULL' if p in FL.FILTER_STATE_PLACES else repr(p)}" for p in places) + " END"
    rem = q
    for kw in FL.FILTER_TYPE_WORDS:
        rem = f"regexp_replace({rem}, '(?i)\\b{esc(kw)}s?\\b', '', 'g')"
    rem = f"regexp_replace({rem}, '(?i)\\b(?:{'|'.join(FL.STOP_WORDS)})\\b\\s*', '', 'g')"
    rem = f"regexp_replace({rem}, '(?i)\\d[\\d,.]*\\s*[km]?\\s*(?:to|-)\\s*\\d[\\d,.]*\\s*[km]?', '', 'g')"
    rem = f"regexp_replace({rem}, '(?i)\\d[\\d,.]*\\s*[km]?', '', 'g')"
    for p in places:
        rem = f"regexp_replace({rem}, '(?i){esc(p)}', '', 'g')"
    rem = f"trim(regexp_replace({rem}, '\\s+', ' ', 'g'))"
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SAVED_FILTER_TEXTS, 1))
    return f"""
WITH sv AS (
  SELECT * FROM (VALUES {values}) v(filter_id, text)
  UNION ALL
  SELECT 1000 + row_number() OVER (ORDER BY scheme_name), lower(scheme_name) || ' under ' || CAST(CAST(trunc(mx / 1000) AS BIGINT) AS VARCHAR) || 'k'
  FROM (SELECT scheme_name, max(price_value) AS mx FROM published WHERE scheme_name <> '' GROUP BY 1) s)
SELECT filter_id, text, {typ} AS type,
       CASE WHEN {is_range} THEN {amt(g(rr, 1), g(rr, 2))} ELSE {over} END AS min_price,
       CASE WHEN {is_range} THEN {amt(g(rr, 3), g(rr, 4))} ELSE {under} END AS max_price,
       {loc} AS location, {city} AS city, CASE WHEN length({rem}) > 2 THEN {rem} END AS search
FROM sv"""


view("saved_parsed", _sql_parse(), ("published",))


@register("b26_parse_saved_filters", "B26", views=("saved_parsed",), sql="SELECT * FROM saved_parsed")
def b26_parse_saved_filters(spark, sf_dir):
    return FL.parsed_filters(_saved(spark, sf_dir))


@register("d12_match_saved_filters", "D12, B26, F3", views=("saved_parsed", "dedup_pub"), sql="""
WITH act AS (SELECT * FROM dedup_pub WHERE NOT is_expired),
m AS (
  SELECT f.filter_id, a.p_partkey FROM saved_parsed f JOIN act a
    ON (f.type IS NULL OR a.property_type = f.type)
   AND (f.min_price IS NULL OR f.min_price = 0 OR a.price_value >= f.min_price)
   AND (f.max_price IS NULL OR f.max_price = 0 OR a.price_value <= f.max_price)
   AND (f.location IS NULL OR f.city IS NOT NULL OR contains(lower(a.location), lower(f.location)))
   AND (f.city IS NULL OR contains(a.search_text, f.city))
   AND (f.search IS NULL OR list_bool_and(list_transform(string_split_regex(lower(f.search), '\\s+'), lambda t: contains(a.search_text, t)))))
SELECT f.filter_id, f.text, count(m.p_partkey) AS n_matches
FROM saved_parsed f LEFT JOIN m ON m.filter_id = f.filter_id GROUP BY 1, 2""")
def d12_match_saved_filters(spark, sf_dir):
    counts, _ = FL.match_saved_filters(FL.parsed_filters(_saved(spark, sf_dir)), R.dedup_listings(C.published(spark, sf_dir)), C.ENTITY)
    return counts
