"""The incremental mergers as Structured Streaming: partial statistics, edge sets and histogram entries that keep coming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.store import shared_folder
from gridloom.operators import multiset


def edge_stats(values: DataFrame) -> DataFrame:
    """Running (u, v, count, mean, m2, min, max) of a stream of contact values (u, v, v_); for update or complete mode."""
    n = F.count(F.lit(1)).cast("double")
    return values.groupBy("u", "v").agg(
        n.alias("count"), F.avg("v_").alias("mean"), (F.var_pop("v_") * n).alias("m2"), F.min("v_").alias("min"), F.max("v_").alias("max")
    )


def edge_set(pairs: DataFrame) -> DataFrame:
    """Each canonical edge of a stream of (u, v) once, when it first comes; for append mode. The state grows with the edges."""
    named = pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return named.dropDuplicates(["u", "v"])


class EntryStore:
    """A store of distinct histogram entries that batches of a stream add to: ``stream.writeStream.foreachBatch(store.update)``.

    Each batch writes a new version of the store, named by the batch's number, so a batch that is run again after a failure
    starts from the version before it; older versions are removed. Without a path, a store has a new folder of its own; to go
    on with a store later, give it one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/entry-store-{uuid.uuid4().hex}"

    def version(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{batch_id}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch of entries (entry_id, entry)."""
        if batch_id == 0:
            merged = multiset.merge_entries(batch.limit(0), batch)
        else:
            merged = multiset.merge_entries(self.version(batch_id - 1), batch)
        merged.write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        if batch_id > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch_id - 2}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
