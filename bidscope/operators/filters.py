"""Saved filters: free-text parsing (B26) and matching against active listings.

Parsing looks words up in fixed lexicons: one pattern finds all type words of a text, and the longest decides; places are looked up in
an array, longest first. Matching goes by an index instead of comparing every filter with every listing: a listing has a key
for each three-letter run of its texts and for each dyadic price interval that its price lies in, by type and for all types; a filter
asks either for the rarest run that its words need or for the few intervals that make up its price range, whichever fewer listings have.
The pairs that meet are then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Type keywords and the type each stands for.
FILTER_TYPE_WORDS = {
    "landed": "Landed", "house": "Landed", "houses": "Landed", "bungalow": "Landed", "terrace": "Landed",
    "semi-d": "Landed", "semi detached": "Landed",
    "condo": "High-rise", "condos": "High-rise", "condominium": "High-rise", "apartment": "High-rise",
    "high-rise": "High-rise", "highrise": "High-rise", "flat": "High-rise", "soho": "High-rise",
    "commercial": "Commercial", "shop": "Commercial", "office": "Commercial", "retail": "Commercial",
    "industrial": "Industrial", "factory": "Industrial", "warehouse": "Industrial",
    "land": "Land",
}
# Place names recognised in filter text ('melaka' appears twice in the reference's list).
FILTER_PLACES = (
    "kuala lumpur", "kl", "selangor", "johor", "penang", "perak",
    "kedah", "kelantan", "terengganu", "pahang", "negeri sembilan", "melaka",
    "sabah", "sarawak", "putrajaya", "labuan", "kl/selangor",
    "petaling jaya", "shah alam", "subang jaya", "puchong", "ampang",
    "cheras", "kepong", "setapak", "wangsa maju", "bangsar",
    "mont kiara", "damansara", "cyberjaya", "kajang", "semenyih",
    "rawang", "klang", "johor bahru", "ipoh", "george town",
    "kota kinabalu", "kuching", "seremban", "melaka", "alor setar",
)
FILTER_STATE_PLACES = (
    "kuala lumpur", "kl", "selangor", "johor", "penang", "perak", "kedah", "kelantan", "terengganu", "pahang",
    "negeri sembilan", "melaka", "sabah", "sarawak", "putrajaya", "labuan", "kl/selangor",
)
# Words that a filter's keywords leave out.
STOP_WORDS = ("under", "below", "above", "over", "less", "more", "than", "max", "min", "from", "budget", "rm", "in")

# The forms of price bounds in filter text.
_NUM = r"(\d[\d,.]*)\s*(k|m)?"
RANGE_RE = r"(?i)(?:rm\s*)?" + _NUM + r"\s*(?:to|-)\s*(?:rm\s*)?" + _NUM
UNDER_RE = r"(?i)(?:under|below|less\s+than|max|budget)\s+(?:rm\s*)?" + _NUM
OVER_RE = r"(?i)(?:above|over|more\s+than|min|from)\s+(?:rm\s*)?" + _NUM


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/-" else ch for ch in s)


def _amount(num: Column, unit: Column) -> Column:
    # parseFloat semantics: the leading number of the text without commas
    n = F.regexp_extract(F.regexp_replace(num, ",", ""), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    return n * F.when(F.lower(unit) == "k", 1_000.0).when(F.lower(unit) == "m", 1_000_000.0).otherwise(1.0)


def _ordered_places():
    # longest first; the stable sort keeps list order among equal lengths
    seen, out = set(), []
    for p in sorted(FILTER_PLACES, key=len, reverse=True):
        if p not in seen:
            seen.add(p)
            out.append(p)
    return out


def parse_filter_query(text) -> Column:
    """struct(type, min_price, max_price, location, city, search) from free text.

    type: first type keyword found as a whole word, longest keyword first (Q5). price: 'a to b' / 'a - b'
    range when a unit, 'rm' or a 4+ digit number makes it a price (Q6), else the bound after under/below/
    less than/max/budget and after above/over/more than/min/from, with k/m units. location: the longest place
    contained; 'kl' -> Kuala Lumpur; a place that is not a state is also a city keyword. search: the text
    with recognised words, amounts and places removed, kept when longer than 2 chars (stop words removed as
    intended, Q4)."""
    q = F.lower(F.trim(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))))
    words = sorted(FILTER_TYPE_WORDS, key=len, reverse=True)
    found = F.regexp_extract_all(q, F.lit("(?<![a-z0-9])(" + "|".join(map(_re_escape, words)) + ")(?![a-z0-9])"), F.lit(1))
    first = F.array_min(F.transform(found, lambda w: F.array_position(F.array(*map(F.lit, words)), w)))
    typ = F.get(F.array(*(F.lit(FILTER_TYPE_WORDS[w]) for w in words)), first.cast("int") - 1)

    r1, ru1, r2, ru2 = (F.regexp_extract(q, RANGE_RE, i) for i in (1, 2, 3, 4))
    whole_range = F.regexp_extract(q, RANGE_RE, 0)
    is_price_range = (whole_range != "") & (
        (ru1 != "") | (ru2 != "") | whole_range.contains("rm")
        | (F.length(F.regexp_replace(r1, r"[^0-9]", "")) >= 4) | (F.length(F.regexp_replace(r2, r"[^0-9]", "")) >= 4))
    under = F.when(F.regexp_extract(q, UNDER_RE, 0) != "", _amount(F.regexp_extract(q, UNDER_RE, 1), F.regexp_extract(q, UNDER_RE, 2)))
    over = F.when(F.regexp_extract(q, OVER_RE, 0) != "", _amount(F.regexp_extract(q, OVER_RE, 1), F.regexp_extract(q, OVER_RE, 2)))
    min_price = F.when(is_price_range, _amount(r1, ru1)).otherwise(over)
    max_price = F.when(is_price_range, _amount(r2, ru2)).otherwise(under)

    places = _ordered_places()
    shown = ["Kuala Lumpur" if p == "kl" else " ".join(w[:1].upper() + w[1:] for w in p.split(" ")) for p in places]
    lexicon = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(n).alias("shown"), F.lit(None if p in FILTER_STATE_PLACES else p).cast("string").alias("city")) for p, n in zip(places, shown)))
    place = F.get(F.filter(lexicon, lambda x: q.contains(x["place"])), F.lit(0))

    rem = F.regexp_replace(q, r"(?i)\b(?:" + "|".join(map(_re_escape, words)) + r")s?\b", "")
    rem = F.regexp_replace(rem, r"(?i)\b(?:" + "|".join(STOP_WORDS) + r")\b\s*", "")
    rem = F.regexp_replace(rem, r"(?i)\d[\d,.]*\s*[km]?\s*(?:to|-)\s*\d[\d,.]*\s*[km]?", "")
    rem = F.regexp_replace(rem, r"(?i)\d[\d,.]*\s*[km]?", "")
    rem = F.regexp_replace(rem, "(?i)(?:" + "|".join(map(_re_escape, places)) + ")", "")
    rem = F.trim(F.regexp_replace(rem, r"\s+", " "))
    search = F.when(F.length(rem) > 2, rem)
    return F.struct(typ.alias("type"), min_price.alias("min_price"), max_price.alias("max_price"),
                    place["shown"].alias("location"), place["city"].alias("city"), search.alias("search"))


def parsed_filters(saved: DataFrame) -> DataFrame:
    """saved_filters(filter_id, text) -> one row per filter with the parsed fields."""
    return saved.select("filter_id", "text", parse_filter_query(F.col("text")).alias("f")).select("filter_id", "text", "f.*")


#: Prices are indexed in steps of ``CELL``, in intervals of 1, 2, 4, ... ``2 ** LEVELS`` steps; what lies beyond is in the last step.
CELL, LEVELS = 1000, 20
ANY_TYPE = "*"


def _runs(text: Column, kind: str) -> Column:
    """The keys of the three-letter runs of a text."""
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat(F.lit(kind), F.substring(text, i, F.lit(3)))))


def _interval(level: Column, cell: Column, of_type: Column) -> Column:
    return F.concat_ws(":", F.lit("p"), level.cast("string"), cell.cast("string"), of_type)


def _type_key(c: str) -> Column:
    return F.concat(F.lit("="), F.coalesce(c, F.lit("")))


def _cell(price: Column) -> Column:
    return F.least(F.greatest(F.floor(price / CELL), F.lit(0)), F.lit((1 << LEVELS) - 1)).cast("long")


def listing_keys(act: DataFrame, entity: str) -> DataFrame:
    """``(entity, key)``: the index entries of the listings."""
    cell, levels = _cell(F.coalesce("price_value", F.lit(0))), F.sequence(F.lit(0), F.lit(LEVELS))
    at = lambda t: F.transform(levels, lambda k: _interval(k, F.call_function("shiftright", cell, k), t))
    keys = F.concat(at(_type_key("property_type")), at(F.lit(ANY_TYPE)), _runs(F.col("_st"), "s:"), _runs(F.col("_loc"), "l:"))
    return act.select(entity, F.explode(keys).alias("key"))


def filter_keys(filters: DataFrame) -> DataFrame:
    """``(filter_id, by_run, key)``: the intervals that make up a filter's price range, and the runs that its words need, each
    enough to find all its matches."""
    lo = F.when(F.coalesce("min_price", F.lit(0.0)) > 0, _cell(F.col("min_price"))).otherwise(F.lit(0).cast("long"))
    hi = F.when(F.coalesce("max_price", F.lit(0.0)) > 0, _cell(F.col("max_price"))).otherwise(F.lit((1 << LEVELS) - 1).cast("long")) + 1
    of_type = F.when(F.col("type").isNull(), F.lit(ANY_TYPE)).otherwise(_type_key("type"))
    # at each level, the interval at either end that its parent would overstep
    f = filters.select("filter_id", of_type.alias("t"), lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("k"))
    f = f.withColumn("a", F.expr("shiftright(lo + shiftleft(1L, k) - 1, k)")).withColumn("b", F.expr("shiftright(hi, k)")).where("a < b")
    ends = F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)))
    by_price = f.select("filter_id", "t", "k", F.explode(F.array_distinct(ends)).alias("c")).select("filter_id", F.lit(False).alias("by_run"), _interval(F.col("k"), F.col("c"), F.col("t")).alias("key"))
    tokens = F.split(F.lower(F.coalesce("search", F.lit(""))), r"\s+")
    wanted = F.concat(F.flatten(F.transform(tokens, lambda t: _runs(t, "s:"))), _runs(F.coalesce("city", F.lit("")), "s:"),
                      F.when(F.col("city").isNull(), _runs(F.lower(F.coalesce("location", F.lit(""))), "l:")).otherwise(F.array().cast("array<string>")))
    by_run = filters.select("filter_id", F.explode(F.array_distinct(wanted)).alias("key")).select("filter_id", F.lit(True).alias("by_run"), "key")
    return by_price.unionByName(by_run)


def filter_candidates(filters: DataFrame, act: DataFrame, entity: str) -> DataFrame:
    """``(filter_id, entity)``: pairs that share the key with the fewest listings that finds all matches of the filter; no pair twice."""
    asked = filter_keys(filters)
    entries = stored(listing_keys(act, entity).join(asked.select("key").distinct(), "key", "left_semi"), "filter-index")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sized = asked.join(sizes, "key", "left").select("filter_id", "by_run", "key", F.coalesce("n", F.lit(0)).alias("n"))
    best = sized.groupBy("filter_id").agg(F.min(F.when(F.col("by_run"), F.struct("n", "key"))).alias("run"), F.sum(F.when(~F.col("by_run"), F.col("n"))).alias("n_price"))
    chosen = sized.join(best, "filter_id").where(
        F.when(F.coalesce(F.col("run.n") <= F.coalesce("n_price", F.lit(0)), F.lit(False)), F.col("by_run") & (F.col("key") == F.col("run.key"))).otherwise(~F.col("by_run")))
    return entries.join(chosen.select("filter_id", "key"), "key").select("filter_id", entity)


def match_saved_filters(filters: DataFrame, listings: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(count per filter including 0, matching (filter_id, entity) pairs). ``listings`` are the
    deduplicated published rows; only non-expired ones match. Conditions: type equal, price_value within the
    bounds, state substring of the location when no city, city substring of the search text, every keyword
    a substring of the search text."""
    act = listings.filter(~F.col("is_expired")).select(
        entity, "property_type", "price_value", F.lower(F.coalesce("location", F.lit(""))).alias("_loc"),
        F.coalesce("search_text", F.lit("")).alias("_st"))
    pairs = filter_candidates(filters, act, entity)
    rows = pairs.join(filters.select("filter_id", "type", "min_price", "max_price", "location", "city", "search"), "filter_id").join(act, entity)
    pv = F.coalesce(F.col("price_value"), F.lit(0))
    cond = (
        (F.col("type").isNull() | F.col("property_type").eqNullSafe(F.col("type")))
        & (F.col("min_price").isNull() | (F.col("min_price") == 0) | (pv >= F.col("min_price")))
        & (F.col("max_price").isNull() | (F.col("max_price") == 0) | (pv <= F.col("max_price")))
        & (F.col("location").isNull() | F.col("city").isNotNull() | F.col("_loc").contains(F.lower(F.col("location"))))
        & (F.col("city").isNull() | F.col("_st").contains(F.col("city")))
    )
    tokens = F.split(F.lower(F.coalesce(F.col("search"), F.lit(""))), r"\s+")
    kw = F.col("search").isNull() | F.forall(tokens, lambda t: F.col("_st").contains(t))
    matched = rows.filter(cond).filter(kw).select("filter_id", entity)
    counts = filters.select("filter_id", "text").join(
        matched.groupBy("filter_id").agg(F.count(F.lit(1)).alias("n")), "filter_id", "left"
    ).select("filter_id", "text", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"))
    return counts, matched
