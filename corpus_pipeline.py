"""A corpus pipeline: language ID, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language, neardup, packing, pii
from tidemark.llm.common import crc32_mod, staged, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or of a language that the network isn't sure of, go; so do null and empty ones.

    Null ids and languages, repeated rows and further columns stay as they are; an empty table stays empty.
    """
    return language.accepted(docs, language.fit(docs.filter(crc32_mod("doc_id", 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id, with all rows that repeat that id.

    Documents without words, or with a null id, are in no group and stay; an empty table stays empty.
    """
    return neardup.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and short texts hold none, and rows with a null id stay.

    Without benchmark items, or without documents, nothing changes.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; null texts stay null, and every row stays."""
    return pii.redact(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which piece of which document goes where in which training sequence; a null text is its end token alone.

    Repeated rows are packed each on its own, a null id stays null, and an empty table gives no rows.
    """
    return packing.packed(docs)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("best-fit packing", packing_plan),
]

#: The stages are trained models and token counts, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)
