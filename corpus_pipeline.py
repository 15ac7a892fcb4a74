"""A training corpus from raw documents: five stages, each reading what the one before it wrote.

The stages return the columns of ``documents``; the last returns the mix: how many words of each
document that is left the training set takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.llm import contamination, jaccard, language_id, line_dedup, mixing
from harborline.session import stage
from harborline.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those no language compresses better than the others."""
    found = language_id.detect(docs, language_id.learn(docs))
    return found.where(~found["rejected"]).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that many sources share out of the texts, but for their first occurrence."""
    return line_dedup.remove_boilerplate(docs).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, by five-word shingles and a similarity of 0.8."""
    return jaccard.keep_one(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return contamination.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document so that the sources meet their target weights."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate),
    ("source_mix", mix),
]

#: Compression sizes and XXH64 fingerprints have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
