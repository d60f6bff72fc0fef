"""Cleaning pipeline for a training corpus: quality, lines, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row per packed piece. ``run`` writes each stage's result as Parquet into
the shared checkpoint folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.llm import best_fit_packing, line_dedup, quality_gam, simhash_join, substring_dedup
from bidscope.llm.common import release, stored, table


def _with_text(df: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` with a new ``text`` and its ``n_chars``."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (score 0.3 or more). The model learns from the labelled documents."""
    model = quality_gam.fit_quality(docs, table(spark, sf_dir, "labels"), label_col="quality")
    scored = quality_gam.add_scores(docs.withColumn("__text", F.col("text")), model, text_col="__text", out_col="__score")
    return scored.where(F.col("__score") >= quality_gam.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; documents stay even if no line is left."""
    kept = line_dedup.dedup_lines(docs, host_col="source")
    return _with_text(kept, docs, F.col("text"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (4-word shingles, 4 bits): the one with the smallest id. Of rows that repeat its id
    one stays; rows without an id stay."""
    found = simhash_join.simhash_components(docs, shingle_words=4, max_bits=4)
    first = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("__keep")).agg(F.count(F.lit(1)).alias("__rows"))
    first = stored(first, "kept")

    def rows_of(ids: DataFrame) -> DataFrame:  # the ids are the small side: texts are neither sorted nor held
        ids = ids.select("__keep").hint("shuffle_hash")
        return docs.join(ids, docs.doc_id == ids["__keep"], "left_semi")

    repeated = rows_of(first.where("__rows > 1")).dropDuplicates(["doc_id"])
    return rows_of(first.where("__rows = 1")).unionByName(repeated).unionByName(docs.where("doc_id is null"))


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that start in a document with a smaller id; an emptied text stays as ''."""
    kept = substring_dedup.dedup_substrings(docs, window=13)
    return _with_text(kept, docs, F.col("kept_text"))


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as token sequences of 2048: one row per piece with its sequence and offset."""
    pieces = best_fit_packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return best_fit_packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_deduplication),
    ("best_fit_packing", best_fit_packing_stage),
]

#: SQL cannot express a trained model; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
