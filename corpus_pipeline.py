"""Documents to training sequences: language, copies, near copies, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmetrics.llm import language
from shelfmetrics.llm.common import read, stored
from shelfmetrics.llm.decontamination import drop_contaminated
from shelfmetrics.llm.exact_dedup import drop_copies
from shelfmetrics.llm.jaccard_join import drop_near
from shelfmetrics.llm.packing import pack


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie within reach of a language; fitted on the rows that name theirs."""
    return language.keep_known(docs, language.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles."""
    return drop_near(docs, width=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=120_000)


STAGES = [("language", known_language), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontamination", without_benchmark),
          ("packing", packed)]

# Nearest centroids, similarity joins, tilings and token ids have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
