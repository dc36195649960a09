"""The corpus pipeline: quality, near duplicates, benchmark items, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontaminate, mixing, near_dedup, quality, token_output
from docspark.llm.common import documents, written
from docspark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    model = quality.train(docs, documents(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.without_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of smaller sources more than once, up to the repetition limit."""
    return mixing.mixed_documents(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents, read back: a row for each document in them."""
    return token_output.token_output(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix),
    ("token_ids", to_token_ids),
]

#: The classifier, the mix and the token ids have no SQL; tests check the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
