"""Phrase collocation mining by top-order marginalisation.

Only windows of the longest order are counted: a word and the words that follow it in its piece, as lead columns, padded where
the piece ends. Spark's ROLLUP over the columns then sums the windows to all shorter prefixes, which are the counts of
the shorter phrases, so no phrase length is exploded on its own.

A window is also padded where no phrase can go on: every part of a phrase that occurs ``min_count`` times occurs as often, so a window
need not go past a run of words that is rarer. Runs of two, three, ... words are counted beforehand by a 64-bit hash, each length only
where both its shorter runs are left; a bitmap of fixed size holds the places of those that reach ``min_count``, with whatever shares
them. It lets no frequent run out, so all counts from ``min_count`` on are exact; the rest is only merged into fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, release, stored
from .substring_dedup import MAP_BITS, mix, shared_map

#: A bitmap has ``2 ** MAP_BITS`` places (16 MB, whatever the input); where it fills up, more rare windows are counted and the result is the same.
#: Bytes of text that are taken apart at once; longer runs of text are cut between words, and the windows go on over the cut.
PART_BYTES = 1 << 22
#: Parts in which a language's best phrases are found before they meet.
RANK_PARTS = 32
NO_LANG = "und"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z become a-z, a tab a blank, and every piece separator a line feed.
FOLD = bytes.maketrans((UPPER + "\t.,;:!?\x0b\x0c\r").encode(), (LOWER + " " + "\n" * 9).encode())
_U = np.uint64


def parts_of(batch: pa.RecordBatch):
    """``(lang, data, last)`` of a batch: folded texts of one language in parts of about ``PART_BYTES``, cut at a blank. A part that
    is not the ``last`` one goes on in the next."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        if text:
            texts.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass").translate(FOLD))
    for lang, some in texts.items():
        data = b"\n".join(some)
        at = 0
        while at < len(data):
            cut = data.find(b" ", at + PART_BYTES) if len(data) - at > PART_BYTES else -1
            yield lang, data[at:cut if cut >= 0 else len(data)], cut < 0
            at = cut if cut >= 0 else len(data)


def word_codes(batch: pa.RecordBatch, reach: int):
    """``(lang, codes, words, n)``: word codes in order, -1 at the end of a piece, the words by code (an Arrow array), and the
    number of places at which windows begin; the rest, ``reach`` places at most, only completes them."""
    held: list[bytes] = []
    for lang, data, last in parts_of(batch):
        tokens = held + [w for w in data.replace(b"\n", b" \n ").split(b" ") if w]
        held = [] if last or not reach else tokens[-reach:]
        found = pa.array(tokens, pa.binary()).dictionary_encode()
        codes = found.indices.to_numpy().astype(np.int64)
        stop = pc.index(found.dictionary, pa.scalar(b"\n", pa.binary())).as_py()
        yield lang, np.where(codes == stop, -1, codes), found.dictionary, len(tokens) - len(held)


def runs(lang: str, codes: np.ndarray, words: pa.Array, longest: int, maps: dict[int, np.ndarray]):
    """``(hash, stands)`` by number of words: hash of the run of 1 to ``longest`` words that begins at each place, and whether it stands in
    one piece, both its runs of one word less are in the ``maps`` and, where there is a map of its length, it is itself."""
    names = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))
    stands = codes >= 0
    first = np.where(stands, mix(names[codes] ^ _U(xxhash.xxh64_intdigest(lang.encode()))), _U(0)) if len(names) else np.zeros(len(codes), dtype=np.uint64)
    out = [(first, stands)]
    for k in range(2, longest + 1):
        hashes, before = out[-1]
        hashes, stands = mix(hashes[:-1] * _U(0x9E3779B97F4A7C15) + first[k - 1:]), before[:-1] & before[1:]
        if k in maps:
            place = hashes >> _U(64 - MAP_BITS)
            stands = stands & ((maps[k][(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1)).astype(bool)
        out.append((hashes, stands))
    return out


def run_counts(docs: DataFrame, length: int, maps: dict) -> DataFrame:
    """Rows ``(key, n)``: runs of ``length`` words, by hash, whose shorter runs are in the maps."""

    def run(batches):
        known = {k: m.value for k, m in maps.items()}
        for b in batches:
            for lang, codes, words, n in word_codes(b, length - 1):
                if len(codes) >= length:
                    hashes, stands = runs(lang, codes, words, length, known)[-1]
                    key, count = np.unique(hashes[:n][stands[:n]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def windows(docs: DataFrame, order: int, maps: dict) -> DataFrame:
    """Padded windows ``(lang, w1 .. w<order>, n)``, counted within a part; '' is the padding."""
    names = ["lang", *(f"w{k + 1}" for k in range(order)), "n"]

    def run(batches):
        known = {k: m.value for k, m in maps.items()}
        for b in batches:
            for lang, codes, words, n in word_codes(b, order - 1):
                start = np.flatnonzero(codes[:n] >= 0)
                if not len(start):
                    continue
                goes_on = [np.append(s, np.zeros(len(codes) - len(s), dtype=bool)) for _, s in runs(lang, codes, words, min(order, len(codes)), known)]
                codes = np.append(codes, np.full(order, -1))
                columns, key, base = [codes[start]], codes[start], len(words) + 1
                for k in range(1, order):
                    columns.append(np.where(goes_on[k][start], codes[start + k], -1) if k < len(goes_on) else np.full(len(start), -1))
                    if int(key.max()) >= (1 << 62) // base:
                        key = np.unique(key, return_inverse=True)[1]
                    key = key * base + columns[-1] + 1
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                taken = [pc.fill_null(words.take(pa.array(c[first], mask=c[first] < 0)), b"").cast(pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(first), dtype=np.int64))), *taken, pa.array(count)], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} string" for c in names[:-1]) + ", n long")


def phrase_counts(docs: DataFrame, order: int, min_count: int) -> DataFrame:
    """Rows ``(lang, words, f)`` of the phrases of 1 to ``order`` words that occur ``min_count`` times or more, and of each language
    with no words, whose ``f`` counts all its words."""
    spark = docs.sparkSession
    maps: dict = {}  # of fixed size, one for each length from 2 on
    for length in range(2, order + 1):
        maps[length] = spark.sparkContext.broadcast(shared_map(run_counts(docs, length, maps).where(F.col("n") >= min_count).select("key")))
        release(spark)
    columns = [f"w{k + 1}" for k in range(order)]
    longest = stored(windows(docs, order, maps).groupBy("lang", *columns).agg(F.sum("n").alias("n")), "windows")
    release(spark)
    summed = longest.rollup("lang", *columns).agg(F.sum("n").alias("f")).where("lang is not null")
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())
    padded = F.exists(F.array(*columns), lambda w: F.coalesce(w == "", F.lit(False)))
    out = stored(summed.where(~padded & (F.col("w1").isNull() | (F.col("f") >= min_count))).select("lang", words.alias("words"), "f"), "phrases")
    discard(longest)
    release(spark)
    return out


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 3, min_count: int = 10, covered_percent: int = 50, top: int = 2000) -> DataFrame:
    """The best phrases of 2 to ``max_words`` words by language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Only A-Z are lower-cased. Texts are split into pieces at ``. , ; : ! ?`` and at line feed, vertical tab, form feed and carriage
    return, pieces into words at blanks and tabs. ``n`` is the number of words of the language, f the number of places at which a
    phrase stands inside a piece, overlaps included. Phrases with ``a = f >= min_count`` are candidates. A cut after the first k
    words gives ``l = f(first part)``, ``r = f(rest)`` and the score floor(10^6 a a / (l r)), in decimals that hold all digits; the lowest score
    counts, at ties the smallest k. A candidate goes where a longer candidate that contains its words has ``covered_percent`` of its count.
    Of each language the ``top`` first by score and ``a``, both falling, and the phrase in byte order are returned.

    A null language counts as ``und``; null and empty texts have no words; every row counts, also where rows repeat. Other
    columns are ignored. Languages without a candidate have no rows, and an empty table gives none.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases need two words and one occurrence")
    bound_batches(df.sparkSession)
    docs = df.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    counted = phrase_counts(docs, max_words, min_count)
    totals = counted.where("size(words) = 0").select("lang", F.col("f").alias("n"))
    parts = counted.where("size(words) between 1 and %d" % (max_words - 1)).select("lang", F.array_join("words", " ").alias("part"), "f")
    found = counted.where("size(words) > 1").select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))

    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = {c: f"cast({c} as decimal(19, 0))" for c in "alr"}
    score = F.expr(f"(1000000 * {exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    # the words one shorter at either end: whatever a longer candidate covers, one of these steps covers as well
    inner = F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))
    longer = found.where("size(words) > 2").select("lang", F.explode(inner).alias("words"), "a")
    longer = longer.groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(F.max("a").alias("most"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered_percent * F.col("a")))

    order = (F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = left.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                                              F.col("cut.score").alias("score"))


def sql(table: str = "documents", min_count: int = 10, covered_percent: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for phrases of 2 and 3 words."""
    cut = "1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f::HUGEINT)"
    return f"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
                FROM {table} WHERE text IS NOT NULL),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
ones AS (SELECT lang, w[i] AS phrase, count(*) AS f FROM places GROUP BY 1, 2),
twos AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM places WHERE i + 1 <= len(w) GROUP BY 1, 2, 3),
threes AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM places WHERE i + 2 <= len(w) GROUP BY 1, 2, 3, 4),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY 1),
c2 AS (SELECT lang, w1, w2, f AS a FROM twos WHERE f >= {min_count}),
c3 AS (SELECT lang, w1, w2, w3, f AS a FROM threes WHERE f >= {min_count}),
s2 AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.a, l.f AS l, r.f AS r, {cut} AS score
       FROM c2 c JOIN ones l ON c.lang = l.lang AND c.w1 = l.phrase JOIN ones r ON c.lang = r.lang AND c.w2 = r.phrase
       WHERE NOT EXISTS (SELECT 1 FROM c3 x WHERE x.lang = c.lang AND ((x.w1 = c.w1 AND x.w2 = c.w2) OR (x.w2 = c.w1 AND x.w3 = c.w2)) AND 100 * x.a >= {covered_percent} * c.a)),
cuts AS (SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.a, 1 AS k, l.f AS l, r.f AS r, {cut} AS score
         FROM c3 c JOIN ones l ON c.lang = l.lang AND c.w1 = l.phrase JOIN twos r ON c.lang = r.lang AND c.w2 = r.w1 AND c.w3 = r.w2
         UNION ALL
         SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, 2, l.f, r.f, {cut}
         FROM c3 c JOIN twos l ON c.lang = l.lang AND c.w1 = l.w1 AND c.w2 = l.w2 JOIN ones r ON c.lang = r.lang AND c.w3 = r.phrase),
s3 AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM cuts) WHERE best = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3))
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= {top}"""
