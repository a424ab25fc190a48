"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, html_text, language_id, line_dedup, packing, preference, quality_rules, sentencepieces, simhash, suffix_dedup
from tidemark.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = preference.preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return df.withColumns({c: preference.as_text(c) for c in ("chosen_spans", "rejected_spans")})


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_exact_dedup, op3_simhash, op4_preference_format, op5_html_text, op6_best_fit_packing, op7_suffix_dedup, op8_sentencepiece, op9_line_dedup, op10_language_id)}
