"""The document pipeline: quality, exact duplicates, near duplicates, benchmark passages, tokens.

Each stage works on all that the one before it kept, under the parameters of the operator's own query. The first four return the columns of `documents`;
the last one row per document that is left. Stages are parted by Parquet tables in the folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectora.llm import decontaminate, exact_dedup, quality, simhash
from sectora.llm.common import discard, stored
from sectora.llm.queries import table, tokenize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.7)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.exact_dedup(docs, keep="max")


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return simhash.near_dedup(docs, shingle=4, radius=4, seed=42)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; documents that are mostly such passages go. n_chars follows the text."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return tokenize(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good_documents), ("exact dedup", distinct_documents), ("near dedup", unlike_documents), ("decontamination", clean_documents), ("tokens", tokens)]

#: A classifier trained here has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)  # the table of the stage before last, or nothing: documents aren't a stored table
    return STAGES[-1][1](spark, docs, sf_dir)
