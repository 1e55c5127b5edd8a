"""Written intermediate tables in the folder that all executors share, and dense numbers in a total order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; set here only where it is unset and all of Spark is on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints/gridloom"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written and read again: its lineage is cut, and lost executors lose none of it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_numbers(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """df with its rows numbered from ``start`` in this order, without one task seeing all rows.

    Rows are sorted by range and numbered within their partition; the partitions' sizes, one row each, give where each
    partition starts. The sorted rows are stored, so both passes see the same partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    local = stored(
        ordered.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
    )
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).cast("long").alias("_s"))
    # One row a partition: small enough to send to all tasks.
    return local.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")
