"""The corpus pipeline: stages that filter, deduplicate and pack documents, each written and read again.

Texts of any length are taken whole, columns of any name pass through all stages but the last, and an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, ngram_join, packing, quality, queries, shared, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity under a model of trusted text does not reject; null and empty texts stay."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def civil_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not find toxic; null and empty texts score 0 and stay."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, _labels(spark, sf_dir)))


def distinct_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts; null is empty, of repeated rows one stays."""
    return exact_dedup.first_of_each_group(docs)


def dissimilar_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicate texts; null ids and texts without words stay."""
    return ngram_join.first_of_each_group(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 token ids; an empty text is its end id alone."""
    return packing.pack(docs, queries.with_end(queries.WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_text),
    ("toxicity", civil_text),
    ("exact_dedup", distinct_text),
    ("ngram_join", dissimilar_text),
    ("packing", packed_tokens),
]

#: SQL stands for neither trained models nor packing; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a Parquet table in the shared folder, kept until the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared.folder(spark)}/pipeline-{uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path, held = f"{folder}/{k}-{name}", shared.written()
        stage(spark, docs, sf_dir).write.parquet(path)
        shared.sweep(spark, held)  # what the stage has written for itself
        if last:
            shared.delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
