"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, suffix dedup, packing.

Edge cases: texts that are null or have no letter are rejected by the first stage; a text that later stages leave empty
stays a document, and empty ones are near-duplicates of each other; repeated rows are one document to the line stage,
and one of them passes the near-duplicate stage; a null doc_id is kept like any other; ties go to the smallest doc_id;
very long texts are whole in every stage; columns beyond those of documents pass through, whatever their names, up to
the last stage; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, packing, simhash, suffix_dedup
from tidemark.llm.common import stored
from tidemark.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no centroid is near go; the others get the predicted language."""
    model = language_id.train(docs)
    return language_id.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, but for the first of each class."""
    return line_dedup.dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: the one of the smallest doc_id."""
    return simhash.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that also start elsewhere go, wherever they are."""
    return suffix_dedup.removed(docs, suffix_dedup.WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", packed),
]
#: Hashed n-gram centroids, edit-distance components, XXH64 fingerprints and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
