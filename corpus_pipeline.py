"""Corpus pipeline over documents: toxicity, near-duplicates, repeated passages, mixture, tokens.

Every stage takes what its predecessor kept, calls one operator, and returns
the rows that stay (the last: their token digests). run() writes each stage as
Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, mixture, near_dedup, suffix_dedup, toxicity
from textloom.llm.common import materialize, table
from textloom.llm.queries import RANKS

#: No SQL: learned scores, sampled hashes and byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on their labels doesn't call toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by shingles of five words."""
    return near_dedup.keep_one_each(docs, width=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur elsewhere too."""
    return suffix_dedup.without_repeats(docs, length=suffix_dedup.PASSAGE_WORDS, gram=suffix_dedup.PASSAGE_GRAM, unit="words")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities."""
    return mixture.mix_sources(docs).where("sampled").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of each document."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("mixture", mix_sources), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return docs
