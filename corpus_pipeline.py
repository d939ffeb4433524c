"""From documents to packed token sequences: five stages, each over all rows its predecessor kept.

run() writes each stage's result, from which the next begins, and then removes the stage's scratch
tables and the result before. What it returns reads the scratch tables of the last stage alone;
they are of this run only and stay.

Defined results: each stage is its operator, whose module says what becomes of nulls, empty and very
long texts, ties and repeated rows; a null or empty text is rejected by the first stage; columns
besides those of documents are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import language_id, mixing, near_duplicates, packing, quality_rules
from colloquy.llm.common import materialize, remove, scratch_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier rule reject. An empty text is rejected."""
    return quality_rules.quality_rules(docs).where("kept").select(*COLUMNS)


def keep_by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence settles; of any length, read as a whole."""
    return language_id.identify(language_id.document_evidence(docs)).where("accepted").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates; any one of equal rows."""
    return near_duplicates.drop_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a document taken twice is two rows."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_rules", keep_by_quality),
    ("language_id", keep_by_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages are trained models, fingerprints and a tokenizer: nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch_folder(spark) as scratch:
            out = stage(spark, docs, sf_dir)
        if stage is STAGES[-1][1]:
            break
        with scratch_folder(spark) as handed_over:
            docs = materialize(out, f"pipeline-{name}")
        for path in [scratch, *before]:
            remove(spark, path)
        before = [handed_over]
    # The pieces are written before they are packed.
    for path in before:
        remove(spark, path)
    return out
