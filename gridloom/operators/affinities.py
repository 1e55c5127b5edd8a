"""Neighbour affinities of labels and distances of embeddings, by one stencil join for all offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import stencil_join


def compute_affinities(pixels: DataFrame, offsets, shape, ignore_label: int | None = None) -> DataFrame:
    """(channel, node_id, affinity, mask): 1 where both labels are equal; outside the grid or ignored: 0 and mask 0."""
    joined = stencil_join(pixels.select("node_id", "z", "y", "x", "label"), offsets, shape, ["label"], outer=True)
    good = F.col("to_label").isNotNull()
    if ignore_label is not None:
        good &= (F.col("label") != ignore_label) & (F.col("to_label") != ignore_label)
    return joined.select(
        "channel", "node_id", (good & (F.col("label") == F.col("to_label"))).cast("float").alias("affinity"), good.cast("int").alias("mask")
    )


def distance(a: str, b: str, norm: str):
    """l1, l2 or cosine distance of two array columns, summed in double and returned as float."""
    add = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v)
    d = lambda x: x.cast("double")
    if norm == "l1":
        out = add(lambda x, y: F.abs(d(x) - d(y)))
    elif norm == "l2":
        out = F.sqrt(add(lambda x, y: (d(x) - d(y)) * (d(x) - d(y))))
    elif norm == "cosine":
        dot, xx, yy = add(lambda x, y: d(x) * d(y)), add(lambda x, y: d(x) * d(x)), add(lambda x, y: d(y) * d(y))
        size = F.sqrt(xx) * F.sqrt(yy)
        out = F.when(size > 0, 1 - dot / size).otherwise(float("nan"))
    else:
        raise ValueError(f"unknown norm {norm}")
    return out.cast("float")


def compute_embedding_distances(pixels: DataFrame, offsets, shape, norm: str = "l2") -> DataFrame:
    """(channel, node_id, distance): 0 outside the grid."""
    joined = stencil_join(pixels.select("node_id", "z", "y", "x", "embedding"), offsets, shape, ["embedding"], outer=True)
    value = F.when(F.col("to_embedding").isNull(), F.lit(0.0).cast("float")).otherwise(distance("embedding", "to_embedding", norm))
    return joined.select("channel", "node_id", value.alias("distance"))
