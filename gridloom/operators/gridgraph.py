"""The implicit nearest-neighbour graph of a grid: ids by arithmetic, no lookup.

Edge ids are axis-major: all edges along the first axis, then the next, each in C-order of the lower pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import coordinates, full_offset, inside, node_id, stencil_join, with_targets
from gridloom.functions.store import row_numbers


def axis_starts(shape) -> list[int]:
    """First edge id of each axis, and the number of edges."""
    starts = [0]
    for axis in range(3):
        n = 1
        for k in range(3):
            n *= shape[k] - (k == axis)
        starts.append(starts[-1] + n)
    return starts


def edge_id(z: Column, y: Column, x: Column, axis: int, shape) -> Column:
    """Id of the edge from a pixel along an axis (it must exist)."""
    s = [n - (k == axis) for k, n in enumerate(shape)]
    return (z.cast("long") * s[1] + y) * s[2] + x + axis_starts(shape)[axis]


def grid_nodes(spark: SparkSession, shape) -> DataFrame:
    nodes = spark.range(shape[0] * shape[1] * shape[2]).withColumnRenamed("id", "node_id")
    z, y, x = coordinates(F.col("node_id"), shape)
    return nodes.select("node_id", z.alias("z"), y.alias("y"), x.alias("x"))


def grid_edges(spark: SparkSession, shape) -> DataFrame:
    """(edge_id, u, v, axis): made from ids alone."""
    out = None
    starts = axis_starts(shape)
    step = [shape[1] * shape[2], shape[2], 1]
    for axis in range(3):
        s = tuple(n - (k == axis) for k, n in enumerate(shape))
        if 0 in s:
            continue
        ids = spark.range(starts[axis], starts[axis + 1]).withColumnRenamed("id", "edge_id")
        u = node_id(*coordinates(F.col("edge_id") - starts[axis], s), shape)
        rows = ids.select("edge_id", u.alias("u"), (u + step[axis]).alias("v"), F.lit(axis).alias("axis"))
        out = rows if out is None else out.unionByName(rows)
    return out


def project_edge_ids(spark: SparkSession, shape) -> DataFrame:
    """(axis, node_id, edge_id): each edge id at its lower pixel, -1 where there is no edge."""
    nodes = grid_nodes(spark, shape)
    z, y, x = F.col("z"), F.col("y"), F.col("x")
    axes = [a for a in range(3) if shape[a] > 1 or a > 0]
    cases = F.array(
        *(
            F.struct(F.lit(a).alias("axis"), F.when((z, y, x)[a] < shape[a] - 1, edge_id(z, y, x, a, shape)).otherwise(-1).cast("long").alias("e"))
            for a in axes
        )
    )
    return nodes.select("node_id", F.explode(cases).alias("c")).select(F.col("c.axis").alias("axis"), "node_id", F.col("c.e").alias("edge_id"))


def project_offset_edge_ids(pixels: DataFrame, offsets, shape, strides=None) -> DataFrame:
    """(channel, node_id, edge_id): valid (offset, pixel) pairs numbered in order of channel and pixel, -1 for others.
    With strides, only pixels whose coordinates they divide are valid; with a boolean column ``mask``, where it is true."""
    rows = with_targets(pixels, offsets, shape, outer=True)
    good = F.col("to").isNotNull()
    if strides is not None:
        for name, s in zip(("z", "y", "x"), full_offset(strides), strict=True):
            good &= (F.col(name) % max(s, 1)) == 0
    if "mask" in pixels.columns:
        good &= F.col("mask")
    rows = rows.select("channel", "node_id", good.alias("good"))
    valid = row_numbers(rows.where("good").select("channel", "node_id"), ["channel", "node_id"], "edge_id")
    rejected = rows.where("NOT good").select("channel", "node_id", F.lit(-1).cast("long").alias("edge_id"))
    return valid.select("channel", "node_id", "edge_id").unionByName(rejected)


def grid_boundary_features(pixels: DataFrame, shape, value: str = "value") -> DataFrame:
    """(edge_id, weight): half the sum of a map over each grid edge."""
    steps = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    joined = stencil_join(pixels, steps, shape, [value])
    z, y, x = F.col("z"), F.col("y"), F.col("x")
    e = F.coalesce(*(F.when(F.col("channel") == a, edge_id(z, y, x, a, shape)) for a in range(3)))
    return joined.select(e.alias("edge_id"), (0.5 * (F.col(value) + F.col(f"to_{value}"))).alias("weight"))


def _check_local(offsets) -> list[tuple[int, tuple[int, int, int]]]:
    local, seen = [], set()
    for c, o in enumerate(map(full_offset, offsets)):
        if not any(o):
            raise ValueError("a zero offset joins no pixels")
        if sum(map(abs, o)) == 1:
            axis = [abs(d) for d in o].index(1)
            if axis in seen:
                raise ValueError("two offsets are the same grid edges")
            seen.add(axis)
            local.append((c, o))
    return local


def grid_affinity_features(spark: SparkSession, affinities: DataFrame, offsets, shape) -> DataFrame:
    """(edge_id, weight, valid): affinities (channel, node_id, affinity) of one-step offsets on the grid's edges; the
    lower pixel of a negative offset is its target. Edges that none covers: 0 and false."""
    local = _check_local(offsets)
    z, y, x = coordinates(F.col("node_id"), shape)
    found = None
    for c, o in local:
        axis = [abs(d) for d in o].index(1)
        pivot = [k + min(d, 0) for k, d in zip((z, y, x), o, strict=True)]
        rows = affinities.where((F.col("channel") == c) & inside(z + o[0], y + o[1], x + o[2], shape)).select(
            edge_id(*pivot, axis, shape).alias("edge_id"), F.col("affinity").alias("weight")
        )
        found = rows if found is None else found.unionByName(rows)
    every = spark.range(axis_starts(shape)[3]).withColumnRenamed("id", "edge_id")
    if found is None:
        return every.select("edge_id", F.lit(0.0).alias("weight"), F.lit(False).alias("valid"))
    return every.join(found, "edge_id", "left").select("edge_id", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("weight").isNotNull().alias("valid"))


def grid_lifted_edges(affinities: DataFrame, offsets, shape) -> DataFrame:
    """(channel, node_id, u, v, weight): a row for each hit of an offset longer than one step."""
    full = [full_offset(o) for o in offsets]
    if any(tuple(-d for d in o) in full for o in full):
        raise ValueError("an offset and its opposite are the same edges")
    z, y, x = coordinates(F.col("node_id"), shape)
    out = None
    for c, o in enumerate(full):
        if sum(map(abs, o)) <= 1:
            continue
        to = node_id(z + o[0], y + o[1], x + o[2], shape)
        rows = affinities.where((F.col("channel") == c) & inside(z + o[0], y + o[1], x + o[2], shape)).select(
            "channel", "node_id", F.least("node_id", to).alias("u"), F.greatest("node_id", to).alias("v"), F.col("affinity").alias("weight")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def grid_affinity_features_with_lifted(spark: SparkSession, affinities: DataFrame, offsets, shape) -> tuple[DataFrame, DataFrame]:
    """(grid_affinity_features of the one-step offsets, grid_lifted_edges of the others), channels as in ``offsets``. A zero
    offset, or one with its opposite, is an error."""
    full = [full_offset(o) for o in offsets]
    if any(not any(o) for o in full):
        raise ValueError("an offset of no steps")
    lifted = grid_lifted_edges(affinities, offsets, shape)
    short = [k for k, o in enumerate(full) if sum(map(abs, o)) == 1]
    number = F.create_map(*(F.lit(x) for k, c in enumerate(short) for x in (c, k))) if short else F.lit(None)
    own = affinities.where(F.col("channel").isin(short)).withColumn("channel", number[F.col("channel")] if short else F.col("channel"))
    if lifted is None:
        lifted = affinities.limit(0).select("channel", "node_id", F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.col("affinity").alias("weight"))
    return grid_affinity_features(spark, own, [full[k] for k in short], shape), lifted
