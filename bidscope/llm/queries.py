"""Named queries of the training-data operators over the test tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, bpe_automaton, collocations, embedding_join, html_text, lexical_search, license_scan, line_dedup, quality_gam, simhash_join, spot_signatures, substring_dedup, unigram_counts
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests. Null texts count as empty."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_automaton.bpe_decode(bpe_automaton.bpe_encode(docs, path).select("doc_id", "ids"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe_automaton.id_digest("ids").alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece count of every document. Null texts have 0 pieces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = unigram_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens")


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95 or more."""
    return embedding_join.embedding_components(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint (4-word shingles) and group at 4 or fewer differing bits of every document."""
    found = simhash_join.simhash_components(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that start in a document with a smaller id. Null texts have no words."""
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = best_fit_packing.token_pieces(table(spark, sf_dir, "documents"), path, capacity=2048, end_id=0)
    packed = best_fit_packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source. Null texts count as empty in the digest."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL["op7_line_dedup"] = line_dedup.sql()


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled documents outside the held-out fold."""
    return quality_gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_col="quality", folds=5, threshold=0.3)


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot-signature fingerprints of every document and its edited text, and their likeness."""
    return spot_signatures.fingerprint_chain(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document, by its licence paragraphs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.fit(docs))
    families = F.transform("licences", lambda x: x["family"])
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(families, lambda x: x != license_scan.UNKNOWN))), ",").alias("families"),
                        F.size("licences").alias("n_paragraphs"), F.size(F.filter(families, lambda x: x == license_scan.UNKNOWN)).alias("n_unknown"),
                        F.array_max(F.transform("licences", lambda x: x["probability"])).alias("top_probability"))


@query
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


SQL["op11_ranked_lexical_search"] = lexical_search.sql(20)


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, covered_percent=50, top=2000)


SQL["op13_phrase_collocations"] = collocations.sql()


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
