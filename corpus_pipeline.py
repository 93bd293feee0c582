"""From raw documents to packed training sequences, in stages that each read what the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geofit.llm import decontam, jaccard_join, langid, packing, suffix_dedup
from geofit.llm.common import staged, table

#: A document whose distance to the nearest profile is nearly the greatest is in none of the languages.
LEAST_SCORE = 0.1
#: Passages of over 50 words are cut out where they repeat, however many bytes they have.
PASSAGE_WORDS = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or unlike all learned languages go. The label of the rest stays as it is."""
    profiles = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs, profiles)
    return found.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, k=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur more than once in what is left are cut out wherever they stand."""
    return suffix_dedup.strip_passages(docs, PASSAGE_WORDS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("packed", packed),
]

#: Tokens and language profiles are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
