"""A corpus pipeline of the operators in ``gridloom.llm``; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import pipeline_stages as stages
from gridloom.llm.common import saved, table

STAGES = stages.STAGES

#: The stages learn, hash and encode; SQL can't express them. tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
