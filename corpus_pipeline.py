"""The corpus pipeline: five stages from raw documents to a mixed training order.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept and returns the columns of documents
(extra columns pass through); the last returns the mixed order.  A null text is rejected by the first stage, so later stages
only meet texts with letters; each of them still takes nulls, as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcheck.llm import decontaminate, jaccard, language, mixing, pii
from panelcheck.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: without letters, or no closer to a language than random vectors."""
    return language.in_a_language(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words to a shingle, similarity 0.8 or more."""
    return jaccard.one_of_each_group(docs, rule=jaccard.NEAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in angle brackets; every document stays."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each copy of a document, with its place in the mixed order."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark),
    ("pii", personal_data),
    ("mixture", mixture),
]

#: The language stage is a trained model, which SQL cannot state; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"pipeline-{k}-{name}")
    return docs
