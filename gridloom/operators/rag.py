"""Region adjacency graphs of label volumes, their edge features, and mergeable block statistics.

Pixel tables: (node_id, z, y, x, label, ...). A region graph's edges: (edge_id, u, v), u < v, ids in order of (u, v).
Everything is one stencil join and one aggregation; partial aggregation before the shuffle plays the part of per-block
extraction, so a region of any size (background, say) is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.grid import block_id, forward_offsets, full_offset, label_checked, stencil_join
from gridloom.functions.store import row_numbers

PERCENTILES = (5, 10, 25, 75, 90, 95)


def pair(a: str = "label", b: str = "to_label") -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def numbered(pairs: DataFrame, name: str = "edge_id") -> DataFrame:
    """Distinct (u, v) with ids in order of (u, v)."""
    return row_numbers(pairs.distinct(), ["u", "v"], name).select(name, *pairs.columns)


def contacts(pixels: DataFrame, shape, values: Sequence[str] = ()) -> DataFrame:
    """Direct neighbours with different labels: low pixel's columns, to, to_label, u, v."""
    rows = pixels.withColumn("label", label_checked("label"))
    joined = stencil_join(rows, forward_offsets(shape), shape, ["label", *values])
    return joined.where("label != to_label").withColumns(dict(zip("uv", pair(), strict=True)))


def region_adjacency_graph(pixels: DataFrame, shape) -> DataFrame:
    """(edge_id, u, v): regions that touch along an axis."""
    return numbered(contacts(pixels, shape).select("u", "v"))


def rag_coordinates(pixels: DataFrame, shape, edges: DataFrame) -> DataFrame:
    """(edge_id, contact_no, side, node_id): the pixels of each contact, in scan order, the low one (side 1) then the
    high one (side 2)."""
    touching = contacts(pixels, shape).select("u", "v", "channel", "node_id", "to", "label")
    found = touching.join(edges, ["u", "v"])
    order = Window.partitionBy("edge_id").orderBy("node_id", "channel")
    sided = found.withColumn("contact_no", (F.row_number().over(order) - 1).cast("long")).withColumn(
        "ends",
        F.array(
            F.struct(F.lit(1).alias("side"), F.when(F.col("label") == F.col("u"), F.col("node_id")).otherwise(F.col("to")).alias("node")),
            F.struct(F.lit(2).alias("side"), F.when(F.col("label") == F.col("u"), F.col("to")).otherwise(F.col("node_id")).alias("node")),
        ),
    )
    return sided.select("edge_id", "contact_no", F.explode("ends").alias("e")).select(
        "edge_id", "contact_no", F.col("e.side").alias("side"), F.col("e.node").alias("node_id")
    )


def storage_lengths(coords: DataFrame) -> DataFrame:
    return coords.groupBy("edge_id").agg(F.count(F.lit(1)).alias("length"))


def edges_to_volume(pixels: DataFrame, coords: DataFrame, edge_values: DataFrame, side: int = 0, ignore_value: float = 0.0) -> DataFrame:
    """(node_id, value): contact pixels painted with their edge's value, the highest edge id on top."""
    own = coords if side == 0 else coords.where(F.col("side") == side)
    painted = own.join(edge_values, "edge_id").groupBy("node_id").agg(F.max_by("value", "edge_id").alias("value"))
    return pixels.select("node_id").join(painted, "node_id", "left").select("node_id", F.coalesce("value", F.lit(ignore_value)).alias("value"))


def project_node_labels(pixels: DataFrame, node_labels: DataFrame) -> DataFrame:
    """(node_id, value): each pixel's label looked up in (label, node_label); an error where it is missing."""
    joined = pixels.join(node_labels, "label", "left")
    missing = F.raise_error(F.concat(F.lit("no node label for "), F.col("label"))).cast("long")
    return joined.select("node_id", F.when(F.col("node_label").isNull(), missing).otherwise(F.col("node_label")).alias("value"))


def simple_features(rows: DataFrame, keys: Sequence[str] = ("u", "v")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("v_").alias("mean"), F.count(F.lit(1)).alias("size"))


def complex_features(rows: DataFrame, keys: Sequence[str] = ("u", "v")) -> DataFrame:
    """mean, median, population std, min, max, six percentiles (linear interpolation) and size."""
    at = F.percentile("v_", F.array(*(F.lit(p / 100) for p in (50, *PERCENTILES))))
    return (
        rows.groupBy(*keys)
        .agg(
            F.avg("v_").alias("mean"), F.stddev_pop("v_").alias("std"), F.min("v_").alias("min"), F.max("v_").alias("max"),
            at.alias("p"), F.count(F.lit(1)).alias("size"),
        )
        .select(
            *keys, "mean", F.col("p")[0].alias("median"), "std", "min", "max",
            *(F.col("p")[k + 1].alias(f"p{q}") for k, q in enumerate(PERCENTILES)), "size",
        )
    )


def edge_map_values(pixels: DataFrame, shape, value: str = "value") -> DataFrame:
    """(u, v, v_): half the sum of the map over each contact."""
    return contacts(pixels, shape, [value]).select("node_id", "u", "v", (0.5 * (F.col(value) + F.col(f"to_{value}"))).alias("v_"))


def edge_map_features(pixels: DataFrame, shape, value: str = "value", full: bool = False) -> DataFrame:
    """Features of every region edge from a map over the pixels."""
    rows = edge_map_values(pixels, shape, value)
    return complex_features(rows) if full else simple_features(rows)


def affinity_values(pixels: DataFrame, affinities: DataFrame, offsets, shape) -> DataFrame:
    """(u, v, v_): affinities (channel, node_id, affinity) at the pixels whose offset ends in another region."""
    joined = stencil_join(pixels.withColumn("label", label_checked("label")), offsets, shape, ["label"])
    crossing = joined.where("label != to_label").select("channel", "node_id", *pair())
    return crossing.join(affinities, ["channel", "node_id"]).select("node_id", "channel", "u", "v", F.col("affinity").alias("v_"))


def affinity_features(edges: DataFrame, pixels: DataFrame, affinities: DataFrame, offsets, shape, full: bool = False) -> DataFrame:
    """Features of the region edges; every offset that joins two adjacent regions counts. Edges without any: 0."""
    rows = affinity_values(pixels, affinities, offsets, shape).join(edges.select("u", "v"), ["u", "v"], "left_semi")
    found = complex_features(rows) if full else simple_features(rows)
    out = edges.select("u", "v").join(found, ["u", "v"], "left")
    return out.na.fill(0)


def lifted_edges(edges: DataFrame, pixels: DataFrame, offsets, shape) -> DataFrame:
    """(u, v) of regions that only offsets longer than one step join."""
    long = [o for o in map(full_offset, offsets) if sum(map(abs, o)) > 1]
    joined = stencil_join(pixels.withColumn("label", label_checked("label")), long, shape, ["label"])
    pairs = joined.where("label != to_label").select(*pair()).distinct()
    return pairs.join(edges.select("u", "v"), ["u", "v"], "left_anti")


def lifted_affinity_features(lifted: DataFrame, pixels: DataFrame, affinities: DataFrame, offsets, shape, full: bool = False) -> DataFrame:
    """As affinity_features, for the pairs (u, v) of ``lifted``; a pair that is there twice, in whichever order, is an error."""
    pairs = lifted.groupBy(*pair_of("u", "v")).agg(F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("a pair twice: "), "u", F.lit(" "), "v")).cast("long")).otherwise(F.col("u"))
    return affinity_features(pairs.select(once.alias("u"), "v"), pixels, affinities, offsets, shape, full)


def pair_of(u: str, v: str):
    """The two columns in order, as u and v."""
    return F.least(u, v).alias("u"), F.greatest(u, v).alias("v")


def accumulate_labels(pixels: DataFrame, other: str = "other", ignore_value: int | None = None) -> DataFrame:
    """(label, majority): each region's most frequent other label, the smaller on ties, 0 where all are ignored."""
    counts = pixels.groupBy("label", F.col(other).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    counted = F.lit(True) if ignore_value is None else F.col("o") != ignore_value
    best = F.max_by(F.when(counted, F.col("o")), F.when(counted, F.struct("n", -F.col("o"))))
    return counts.groupBy("label").agg(F.coalesce(best, F.lit(0).cast("long")).alias("majority"))


# Block statistics: (block_id, u, v, count, mean, m2, min, max), mergeable in any order.


def block_region_edges(pixels: DataFrame, shape, block) -> DataFrame:
    """(block_id, u, v): the region edges that each block owns, which are those of contacts whose low pixel it holds."""
    rows = contacts(pixels, shape)
    return rows.select(block_id(F.col("z"), F.col("y"), F.col("x"), shape, block).alias("block_id"), "u", "v").distinct()


def moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1)).cast("double")
    return rows.groupBy(*keys).agg(
        n.alias("count"), F.avg("v_").alias("mean"), (F.var_pop("v_") * n).alias("m2"), F.min("v_").alias("min"), F.max("v_").alias("max")
    )


def block_edge_stats(values: DataFrame, pixels: DataFrame, shape, block) -> DataFrame:
    """Statistics of (node_id, u, v, v_) by the block that holds the pixel."""
    z_y_x = pixels.select("node_id", block_id(F.col("z"), F.col("y"), F.col("x"), shape, block).alias("block_id"))
    return moments(values.join(z_y_x, "node_id"), ["block_id", "u", "v"])


def merge_edges(edges: DataFrame) -> DataFrame:
    """Canonical, distinct, without self edges."""
    return edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def merge_edge_stats(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of each of edges, from any number of partial ones; those of other edges are skipped, missing ones 0.

    m2 = sum(m2 + n mean²) - n mean² loses digits for large means, so the sums are taken around the edge's mean, in a
    second aggregation that reuses the first one's partitioning by (u, v).
    """
    own = stats.where("count > 0").join(edges.select("u", "v"), ["u", "v"], "left_semi")
    mean = own.groupBy("u", "v").agg((F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("all_mean"))
    around = own.join(mean, ["u", "v"])
    out = around.groupBy("u", "v").agg(
        F.sum("count").alias("count"), F.first("all_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("count") * F.pow(F.col("mean") - F.col("all_mean"), 2)).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )
    return edges.select("u", "v").join(out, ["u", "v"], "left").na.fill(0.0)


def finalize_edge_features(stats: DataFrame, full: bool = False) -> DataFrame:
    size = F.col("count").cast("long").alias("size")
    if not full:
        return stats.select("u", "v", "mean", size)
    std = F.when(F.col("count") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("m2") / F.col("count")))).otherwise(0.0)
    return stats.select("u", "v", "mean", std.alias("std"), "min", "max", size)
