"""The corpus pipeline: five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, language_id, ngram_join, packing, substring_dedup
from tideline.llm.common import Scratch, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter, or too low a score) go; ``lang`` becomes the language found."""
    return language_id.keep_known(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 75 % of their word shingles, that of the least id stays."""
    return ngram_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a smaller id has as well are cut out; documents left without a word go."""
    return substring_dedup.remove_duplicates(docs).where("text rlike '[^ \\t-\\r]'")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 5 % of the words or more are from benchmark windows go; all others lose such words."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), cut=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as ids in sequences of at most 4096."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", remove_benchmarks),
    ("packing", pack_sequences),
]

#: SQL has neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
