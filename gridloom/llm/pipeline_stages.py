"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of docs. Null and empty texts, repeated rows, empty tables and extra columns are
treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.bpe import op8_bpe
from gridloom.llm.classify import keep_quality, train_on
from gridloom.llm.common import table
from gridloom.llm.dedup import keep_one
from gridloom.llm.mixing import mix
from gridloom.llm.rules import RULES, keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that break a quality rule. Short ones are no worse than others: that rule is op4's alone."""
    return keep_good(docs, {k: v for k, v in RULES.items() if k != "too_short"})


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under one half. The model learns from the labelled documents as they came, since the
    rules before have taken away most of the bad ones."""
    return keep_quality(docs, train_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks for."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, as their number and digests, and the digest of what they decode to."""
    return op8_bpe(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
