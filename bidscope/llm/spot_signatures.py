"""Document fingerprints by spot signatures.

A spot is a common word (an anchor); its signature is the anchor with the next ``CHAIN`` content words behind it, common words
left out. The set of a text's signatures is its fingerprint, compared by Jaccard likeness. For joins the sets are
partitioned by length, since sets whose lengths differ by more than the threshold cannot be alike, and only sets that
share one of their rarest signatures are compared.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bound_batches, stored

CHAIN = 2
#: Texts with fewer spot signatures also count every word, alone and with the next content word.
FEW_SPOTS = 16
ANCHORS = frozenset("""
a an the of to and in is are was be that this it for with on as at by or from not
le la les un une des de du et en que qui est pour par sur dans
der die das den ein eine und zu von mit ist im sich auf
el los las una y que por con para del al se su
""".split())
_WORD = re.compile(r"[^\W_]+")


def _hashed(strings: set[str]) -> frozenset[int]:
    hashes = (xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings)
    return frozenset(np.fromiter(hashes, dtype=np.uint64, count=len(strings)).view(np.int64).tolist())


def spots(text: str | None) -> frozenset[int]:
    """64-bit hashes (signed) of a text's spot signatures."""
    out, ahead = set(), ("", "")
    for w in reversed(_WORD.findall((text or "").lower())):
        if w not in ANCHORS:
            ahead = (w, ahead[0])
        elif ahead[0]:
            out.add(f"{w} {ahead[0]} {ahead[1]}")
    return _hashed(out)


def word_signatures(text: str | None) -> frozenset[int]:
    """Every word as an anchor: alone, and with the content word behind it."""
    out, behind = set(), ""
    for w in reversed(_WORD.findall((text or "").lower())):
        out.update((f"\n{w}", f"\n{w} {behind}"))
        behind = w if w not in ANCHORS else behind
    return _hashed(out)


def signatures(text: str | None) -> frozenset[int]:
    """The fingerprint: spot signatures, and with fewer than ``FEW_SPOTS`` of them the words' signatures as well.

    A text without words has none.
    """
    found = spots(text)
    return found if len(found) >= FEW_SPOTS else found | word_signatures(text)


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """Jaccard likeness; two empty sets are alike."""
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def text_likeness(a: str, spots_a: frozenset[int], b: str, spots_b: frozenset[int]) -> float:
    """Likeness of two texts by their spots; where one has few, both take their words' signatures as well."""
    if min(len(spots_a), len(spots_b)) < FEW_SPOTS:
        return likeness(spots_a | word_signatures(a), spots_b | word_signatures(b))
    return likeness(spots_a, spots_b)


def digest(s: frozenset[int]) -> str:
    """A short name of a signature set: equal sets have equal names."""
    return hashlib.sha256(np.sort(np.fromiter(s, dtype="<i8", count=len(s))).tobytes()).hexdigest()[:32]


def add_signatures(df: DataFrame, text_col: str = "text", out_col: str = "signatures") -> DataFrame:
    """Add ``out_col`` (sorted array<long>); null and empty texts have no signatures. A column of that name is replaced."""

    def make():
        return lambda b: [pa.array([sorted(signatures(t)) for t in b.column(text_col).to_pylist()], pa.list_(pa.int64()))]

    return add_columns(df, [T.StructField(out_col, T.ArrayType(T.LongType()))], make)


def alike_sets(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Near-duplicates by signature sets: ``members(id, class_id)`` and ``pairs(a, b, likeness)`` between classes.

    A class holds the rows of equal sets and is named by their smallest id; pairs have ``text_likeness`` >= ``threshold``:
    texts with enough spots are joined by their spots; one with few spots is joined to all others by spots and words of both,
    where a class with enough spots has as many sets as its texts differ in words, and the likest one with an id counts. Rows
    with empty sets (no words) form one class. Rows with a null id are in ``members`` only if others share their set.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        def run(batch):
            found = [(own, own | word_signatures(t)) for t in batch.column("text").to_pylist() for own in [spots(t)]]
            few = [len(own) < FEW_SPOTS for own, _ in found]
            return [pa.array([sorted(full if f else own) for (own, full), f in zip(found, few)], pa.list_(pa.int64())),
                    pa.array([sorted(full) for _, full in found], pa.list_(pa.int64())), pa.array(few, pa.bool_())]

        return run

    kind = T.ArrayType(T.LongType())
    signed = add_columns(base, [T.StructField("signatures", kind), T.StructField("whole", kind), T.StructField("few", T.BooleanType())], make)
    rows = stored(signed.select("id", "signatures", "whole", "few"), "spots")
    sets = stored(rows.groupBy("signatures", "few").agg(F.min("id").alias("class_id")).where("class_id is not null"), "sets")
    # what texts with few spots share with a set holds at most FEW_SPOTS - 1 of its spots: sets of more spots than that leaves are not alike
    able = F.size("signatures") - (FEW_SPOTS - 1) <= F.size("whole") * (1 - threshold) + 1e-9
    wide = rows.where(~F.col("few") & able).groupBy("signatures", "whole").agg(F.min("id").alias("node")).where("node is not null")
    wide = wide.join(sets.select("signatures", "class_id"), "signatures").select(F.lit(True).alias("by_words"), "node", "class_id", F.lit(False).alias("few"), F.col("whole").alias("set"))
    nodes = stored(sets.select(F.col("few").alias("by_words"), F.col("class_id").alias("node"), "class_id", "few", F.col("signatures").alias("set")).unionByName(wide), "nodes")
    key, n = ["by_words", "node"], F.size("set")
    # partition k holds the lengths from threshold^-k on: alike sets are in the same or in neighbouring partitions
    part = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int") if threshold < 1 else n
    placed = nodes.where(n > 0).select(*key, "few", n.alias("n"), part.alias("part"), F.explode("set").alias("s"))
    rare = nodes.select("by_words", F.explode("set").alias("s")).groupBy("by_words", "s").count()
    ranked = placed.join(rare, ["by_words", "s"]).groupBy(*key, "few", "n", "part").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("x"))
    prefix = ranked.select(*key, "few", "n", "part", F.explode(F.slice("x", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("x"))
    prefix = stored(prefix.select(*key, "few", "n", "part", F.col("x.s").alias("s")), "prefix")
    around = F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1) if threshold < 1 else F.array("part")
    other = prefix.select("by_words", F.col("node").alias("b"), F.col("few").alias("few_b"), F.col("n").alias("m"), F.explode(around).alias("part"), "s")
    near = prefix.where(F.col("few") | ~F.col("by_words")).withColumnRenamed("node", "a").join(other, ["by_words", "part", "s"])  # by words: one side has few spots
    once = (F.col("a") < F.col("b")) | (F.col("few") != F.col("few_b"))
    near = near.where((F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9) & once).select("by_words", "a", "b", "few_b").distinct()
    x = nodes.where(F.col("few") | ~F.col("by_words")).select("by_words", F.col("node").alias("a"), F.col("set").alias("sa"))
    y = nodes.select("by_words", F.col("node").alias("b"), F.col("few").alias("few_b"), F.col("class_id").alias("class_b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = near.join(x, ["by_words", "a"]).join(y, ["by_words", "b", "few_b"]).select("a", "class_b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness"))
    found = found.where(F.col("likeness") >= threshold).select(F.least("a", "class_b").alias("a"), F.greatest("a", "class_b").alias("b"), "likeness")
    pairs = found.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))
    return rows.join(sets, "signatures").select("id", "class_id"), pairs


def in_order(df: DataFrame, id_col: str, text_col: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """Rows ``(bucket, look, id, text)``: documents in ranges of their ids. The first document of a range is also in the
    range before it (``look`` 1), and that of the first range in the last (``look`` 2), to be seen as the next document."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    firsts = rows.select("id").repartitionByRange(buckets, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id")).collect()
    bounds = sorted({r.id for r in firsts})  # one number for each range
    if not bounds:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("look"), "id", "text"), bounds
    starts = np.array(bounds)

    @F.pandas_udf("int")
    def bucket_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(starts, ids.to_numpy(), side="right") - 1)

    placed = rows.withColumn("b", bucket_of("id"))
    first = F.element_at(F.array(*(F.lit(x).cast("long") for x in bounds)), F.col("b") + 1) == F.col("id")
    own = F.struct(F.col("b").alias("bucket"), F.lit(0).alias("look"))
    ahead = F.struct(F.when(F.col("b") == 0, len(bounds) - 1).otherwise(F.col("b") - 1).alias("bucket"), F.when(F.col("b") == 0, 2).otherwise(1).alias("look"))
    return placed.select(F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))).alias("p"), "id", "text").select("p.bucket", "p.look", "id", "text"), bounds


def fingerprint_chain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness: ``(id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)``.

    The edited text has its last half (rounded down, in code points) replaced by the first as many code points, or all, of
    the next document in ascending id; behind the last comes the first. Null texts count as empty. Rows that repeat an id
    follow each other by text. A row with a null id has no next document: its edited columns and likenesses are null.
    """
    spark = df.sparkSession
    bound_batches(spark)
    placed, _ = in_order(df, id_col, text_col, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    def run(batches):
        here = before = None  # bucket; the document that waits for its next one, with its signatures
        for batch in batches:
            out = []
            for bucket, look, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "look", "id", "text"))):
                text = text or ""
                if bucket != here:
                    here, before = bucket, None
                if look and before is None:
                    continue
                now = (doc, text, spots(text))
                if before is not None:
                    out.append(judged(before, now))
                before = None if look else now
            yield rows(out)

    def judged(a, b):
        doc, text, own = a
        half = len(text) // 2
        edited = text[:len(text) - half] + b[1][:half]
        new = spots(edited) if edited != text else own
        return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(whole(text, own)), digest(whole(edited, new)),
                text_likeness(text, own, edited, new), text_likeness(text, own, b[1], b[2]))

    def whole(text, found):
        return found if len(found) >= FEW_SPOTS else found | word_signatures(text)

    def alone(batches):
        for batch in batches:
            yield rows([(None, len(t or ""), None, digest(signatures(t)), None, None, None) for t in batch.column("text").to_pylist()])

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()))])
    chained = placed.repartition("bucket").sortWithinPartitions("bucket", "look", "id", "text").mapInArrow(run, schema)
    lost = df.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text")).mapInArrow(alone, schema)
    return chained.unionByName(lost)
