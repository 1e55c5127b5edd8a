"""Coordinates, offsets and blocks of a regular grid as column expressions, and the stencil join.

A volume is a pixel table (node_id, z, y, x, ...) with node_id = (z * H + y) * W + x; an image has z = 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = tuple[int, int, int]
Offset = tuple[int, int, int]


def full(shape: Sequence[int]) -> Shape:
    """(depth, height, width) of a 2D or 3D shape."""
    if not 2 <= len(shape) <= 3 or any(n <= 0 for n in shape):
        raise ValueError(f"a grid has 2 or 3 axes of positive length, not {tuple(shape)}")
    return (1, *map(int, shape)) if len(shape) == 2 else tuple(map(int, shape))


def full_offset(offset: Sequence[int]) -> Offset:
    return (0, *map(int, offset)) if len(offset) == 2 else tuple(map(int, offset))


def node_id(z: Column, y: Column, x: Column, shape: Shape) -> Column:
    return (z.cast("long") * shape[1] + y) * shape[2] + x


def idiv(a: Column, n: int) -> Column:
    """Integer quotient, exact for 64-bit numbers."""
    return F.call_function("div", a, F.lit(n))


def coordinates(node: Column, shape: Shape) -> tuple[Column, Column, Column]:
    """(z, y, x) of a node id."""
    _, h, w = shape
    return idiv(node, h * w).cast("int"), (idiv(node, w) % h).cast("int"), (node % w).cast("int")


def inside(z: Column, y: Column, x: Column, shape: Shape) -> Column:
    return (z >= 0) & (z < shape[0]) & (y >= 0) & (y < shape[1]) & (x >= 0) & (x < shape[2])


def forward_offsets(shape: Shape) -> list[Offset]:
    """One step along each axis that is longer than one."""
    return [o for o, n in zip([(1, 0, 0), (0, 1, 0), (0, 0, 1)], shape, strict=True) if n > 1]


def offset_table(offsets: Sequence[Sequence[int]]) -> Column:
    """array<struct<channel, dz, dy, dx>> literal of the offsets in order."""
    rows = [
        F.struct(F.lit(c).alias("channel"), *(F.lit(d).alias(n) for d, n in zip(full_offset(o), ("dz", "dy", "dx"), strict=True)))
        for c, o in enumerate(offsets)
    ]
    return F.array(*rows)


def with_targets(pixels: DataFrame, offsets: Sequence[Sequence[int]], shape: Shape, outer: bool = False) -> DataFrame:
    """Each pixel once for each offset, with channel and the target's node id ``to``; targets outside the grid are left
    out, or null where ``outer``. The offsets are a literal: this is a projection, not a join."""
    spread = pixels.withColumn("o", F.explode(offset_table(offsets)))
    z, y, x = F.col("z") + F.col("o.dz"), F.col("y") + F.col("o.dy"), F.col("x") + F.col("o.dx")
    good = inside(z, y, x, shape)
    spread = spread.withColumn("channel", F.col("o.channel")).withColumn("to", F.when(good, node_id(z, y, x, shape)))
    return (spread if outer else spread.where("to IS NOT NULL")).drop("o")


def stencil_join(
    pixels: DataFrame, offsets: Sequence[Sequence[int]], shape: Shape, values: Sequence[str], outer: bool = False
) -> DataFrame:
    """Pixels with their neighbours at the offsets: columns of pixels, channel, to, and ``to_<value>`` of the target.

    One equi-join by node id for all offsets: pixels are hashed once as targets, and once for each offset as sources.
    """
    left = with_targets(pixels, offsets, shape, outer)
    right = pixels.select(F.col("node_id").alias("to"), *(F.col(v).alias(f"to_{v}") for v in values))
    return left.join(right, "to", "left" if outer else "inner")


def label_checked(label: str) -> Column:
    """The label; an error where it is negative."""
    c = F.col(label).cast("long")
    return F.when(c < 0, F.raise_error(F.lit(f"{label} must not be negative")).cast("long")).otherwise(c)


def mirrored(c: Column, n: int) -> Column:
    """Index reflected into 0..n-1 without repeating the border."""
    if n == 1:
        return F.lit(0)
    period = 2 * (n - 1)
    m = F.pmod(c, F.lit(period))
    return F.when(m < n, m).otherwise(period - m)


def block_id(z: Column, y: Column, x: Column, shape: Shape, block: Shape) -> Column:
    """C-order number of the block that holds a pixel."""
    grid = [-(-n // b) for n, b in zip(shape, block, strict=True)]
    bz, by, bx = (idiv(c.cast("long"), b) for c, b in zip((z, y, x), block, strict=True))
    return (bz * grid[1] + by) * grid[2] + bx
