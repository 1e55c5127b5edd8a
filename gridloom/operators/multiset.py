"""Label multisets: a histogram of labels for each block, rolled up over coarser blocks.

Long form: (block_id, id, count). Encoded form: (block_id, argmax, entry_id) with entries (entry_id, entry
array<struct<id, count>>); equal histograms are one entry, numbered in order of their first block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.grid import block_id
from gridloom.functions.store import row_numbers, stored


def histograms(pixels: DataFrame, shape, block, label: str = "label") -> DataFrame:
    """(block_id, id, count)."""
    b = block_id(F.col("z"), F.col("y"), F.col("x"), shape, block)
    return pixels.groupBy(b.alias("block_id"), F.col(label).alias("id")).agg(F.count(F.lit(1)).alias("count"))


def encode(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, entries) of the long form; argmax is the most frequent id, the smallest on ties."""
    per = rows.groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "count"))).alias("entry"),  # a block's own labels: bounded by the block
        F.max_by("id", F.struct("count", -F.col("id"))).alias("argmax"),
    )
    per = stored(per)
    firsts = per.groupBy("entry").agg(F.min("block_id").alias("first"))
    entries = stored(row_numbers(firsts, ["first"], "entry_id")).select("entry_id", "entry")
    blocks = per.join(entries, "entry").select("block_id", "argmax", "entry_id")
    return blocks, entries


def decode(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """The long form."""
    return blocks.join(entries, "entry_id").select("block_id", F.explode("entry").alias("e")).select("block_id", F.col("e.id").alias("id"), F.col("e.count").alias("count"))


def downsample(rows: DataFrame, grid, factor, restrict: int = -1) -> DataFrame:
    """Long form of blocks joined ``factor`` to one along each axis (grid: blocks by axis); with ``restrict`` > 0, the ids
    of most counts of each, the smaller on ties."""
    _, gy, gx = grid
    b = F.col("block_id")
    pos = (F.call_function("div", b, F.lit(gy * gx)), F.call_function("div", b, F.lit(gx)) % gy, b % gx)
    parent = block_id(*pos, grid, factor)
    out = rows.groupBy(parent.alias("block_id"), "id").agg(F.sum("count").alias("count"))
    return top_ids(out, restrict) if restrict > 0 else out


def top_ids(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block_id").orderBy(F.col("count").desc(), "id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def read_subset(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, count) over some blocks."""
    return rows.join(blocks.select("block_id"), "block_id", "left_semi").groupBy("id").agg(F.sum("count").alias("count"))


def merge_entries(store: DataFrame, batch: DataFrame) -> DataFrame:
    """A store of entries (entry_id, entry) with the batch's unseen ones after its own, in the batch's order."""
    new = batch.groupBy("entry").agg(F.min("entry_id").alias("first")).join(store.select("entry"), "entry", "left_anti")
    start = (store.agg(F.max("entry_id")).first()[0] + 1) if store.head(1) else 0
    added = row_numbers(new, ["first"], "entry_id", start).select("entry_id", "entry")
    return store.select("entry_id", "entry").unionByName(added)


def batch_offsets(store: DataFrame, batch: DataFrame) -> DataFrame:
    """(old_id, entry_id): where a batch's entries are in the store."""
    return batch.select(F.col("entry_id").alias("old_id"), "entry").join(store, "entry").select("old_id", "entry_id")
