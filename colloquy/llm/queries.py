"""The registered queries of this subpackage, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_formatting, fill_in_middle, fingerprints, html_extraction, language_id, mixing, near_duplicates, packing, quality_classifier, quality_rules, substring_dedup, token_alignment, url_filters
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, and all documents, whose declared language and source are evidence as well."""
    pages = language_id.page_evidence(table(spark, sf_dir, "pages")).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "suffix", "host", "domain")
    docs = language_id.document_evidence(table(spark, sf_dir, "documents")).select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "declared", "suffix", "host", "domain")
    found = language_id.identify(pages.unionByName(docs), keep_text=False)
    return found.select("doc_id", "page_id", "language", "probability", "text_language", "declared", "host", "accepted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.with_size(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.with_copies(sized).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.chat_turns(table(spark, sf_dir, "conversations"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_filters.page_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = url_filters.judge(pages.select("page_id", "url"), outcomes)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("posterior", 6).alias("posterior"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text is not needed beyond its fingerprint.
    docs, groups = near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    found = docs.join(groups, "__f0", "left")
    return found.select("doc_id", near_duplicates.hexadecimal(F.col("__f0")).alias("fingerprint"), "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_rules.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    found = quality_rules.reject_outliers(stats.drop("text"))
    return found.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "distance")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.described(token_alignment.align(table(spark, sf_dir, "documents")))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_url_filters": op5_url_filters,
    "op6_simhash": op6_simhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_alignment": op11_token_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_mixing": mixing.ORACLE, "op5_url_filters": url_filters.ORACLE, "op12_substring_dedup": substring_dedup.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE}
