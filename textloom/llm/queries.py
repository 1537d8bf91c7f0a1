"""Queries of the training-data operators, one for each, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import ann, bpe, html_text, mixture, near_dedup, oracles, quality, suffix_dedup, token_counts, token_store, toxicity
from textloom.llm.common import table

JSON_VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON_VOCABULARY))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON_VOCABULARY))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_suffix_dedup, op3_html_text, op4_ann_search, op5_quality, op6_token_store, op7_near_dedup, op8_toxicity, op9_bpe, op10_mixture)
}
#: The other operators: library ids, learned scores, fitted books and hashed draws; tests hold them against brute force.
ORACLE_SQL = {"op2_suffix_dedup": oracles.suffix_dedup_sql(), "op5_quality": oracles.quality_sql(), "op7_near_dedup": oracles.near_dedup_sql()}
