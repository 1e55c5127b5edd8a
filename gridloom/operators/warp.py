"""Resampling of grids at computed coordinates: each target row finds its source pixels by an equi-join on node ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import coordinates, inside, node_id
from gridloom.operators.filters import gaussian_smoothing


def keys_cubic(t: Column) -> Column:
    """Keys' kernel with a = -0.5 at distance t >= 0."""
    near = (1.5 * t - 2.5) * t * t + 1
    far = ((-0.5 * t + 2.5) * t - 4) * t + 2
    return F.when(t <= 1, near).when(t < 2, far).otherwise(0.0)


def b_spline(t: Column, order: int) -> Column:
    """Cardinal B-spline of an order at distance t >= 0: sum over k of (-1)^k C(n + 1, k) ((n + 1) / 2 - t - k)_+^n / n!. Of
    the two mirrored forms this has the fewer terms, one near the end, where the other's cancel."""
    n = order
    terms = [
        F.lit(float((-1) ** k * math.comb(n + 1, k)) / math.factorial(n)) * F.pow(F.greatest((n + 1) / 2 - k - t, F.lit(0.0)), F.lit(float(n)))
        for k in range((n + 1) // 2 + 1)
    ]
    return sum(terms[1:], terms[0])


def _taps(c: Column, order: int) -> list[tuple[Column, Column]]:
    """(index, weight) under the kernel at a coordinate."""
    if order == 0:
        return [(F.floor(c + 0.5).cast("int"), F.lit(1.0))]
    base = F.floor(c).cast("int") if order % 2 or order == 3 else F.floor(c + 0.5).cast("int")
    if order == 1:
        return [(base, 1 - (c - base)), (base + 1, c - base)]
    if order == 3:
        reach, weight = range(-1, 3), keys_cubic
    else:
        reach = range(-(order // 2), order // 2 + 1) if order % 2 == 0 else range(-(order // 2), order // 2 + 2)
        weight = lambda t: b_spline(t, order)
    return [(base + k, weight(F.abs(c - (base + k)))) for k in reach]


def no_pixel(target: Column) -> Column:
    """What a tap outside the grid looks for: nothing that is there, and not one key for all, which would be one task's."""
    return -1 - F.pmod(F.xxhash64(target), F.lit(1 << 62))


def map_coordinates(data: DataFrame, targets: DataFrame, shape, order: int = 1, fill_value: float = 0.0) -> DataFrame:
    """(target, value): data (node_id, value) at targets (target, cz, cy, cx). Order 0 rounds half up, 1 is linear, 3 is
    Keys' cubic, 2, 4 and 5 are B-splines without prefilter; a tap outside the grid counts as ``fill_value``."""
    if order not in range(6):
        raise ValueError("the order is 0 to 5")
    spread = targets
    for c, n in zip(("cz", "cy", "cx"), shape, strict=True):  # the taps of one axis after the other
        taps = [(F.lit(0), F.lit(1.0))] if n == 1 else _taps(F.col(c), order)
        spread = spread.withColumn(f"t{c}", F.explode(F.array(*(F.struct(k.cast("int").alias("k"), x.cast("double").alias("x")) for k, x in taps))))
    z, y, x = (F.col(f"t{c}.k") for c in ("cz", "cy", "cx"))
    weight = F.col("tcz.x") * F.col("tcy.x") * F.col("tcx.x")
    spread = spread.select("target", F.when(inside(z, y, x, shape), node_id(z, y, x, shape)).otherwise(no_pixel(F.col("target"))).alias("at"), weight.alias("w"))
    joined = spread.join(data.select(F.col("node_id").alias("at"), F.col("value").alias("v_")), "at", "left")
    return joined.groupBy("target").agg(F.sum(F.col("w") * F.coalesce("v_", F.lit(fill_value))).alias("value"))


def affine_transform(data: DataFrame, targets: DataFrame, matrix, shape, order: int = 1, fill_value: float = 0.0) -> DataFrame:
    """(target, value) at targets (target, z, y, x): ``matrix`` (rows of an axis, with the shift last) maps a target's
    coordinates to the source's."""
    names = ("z", "y", "x")[3 - len(matrix) :]
    rows = {n: F.lit(0.0) for n in "zyx"}
    for n, row in zip(names, matrix, strict=True):
        rows[n] = sum((F.col(m).cast("double") * w for m, w in zip(names, row[:-1], strict=True)), F.lit(float(row[-1])))
    return map_coordinates(data, targets.select("target", *(rows[n].alias(f"c{n}") for n in "zyx")), shape, order, fill_value)


def axis_rows(matrix, axes: int) -> list[tuple[float, ...]]:
    """The rows of a matrix that has one for each axis, or of a homogeneous one, whose last row must be 0 ... 0 1."""
    rows = [tuple(map(float, row)) for row in matrix]
    if {len(row) for row in rows} != {axes + 1} or len(rows) not in (axes, axes + 1):
        raise ValueError(f"a matrix of {axes} or {axes + 1} rows of {axes + 1} numbers")
    if any(abs(a - b) > 1e-8 for row in rows[axes:] for a, b in zip(row, [0.0] * axes + [1.0], strict=True)):
        raise ValueError("the last row of a homogeneous matrix is 0 ... 0 1")
    return rows[:axes]


def to_integers(value: Column, low: int, high: int) -> Column:
    """Nearest integer, halves away from zero, kept within the bounds; NaN is the lower one."""
    inner = F.round(value).cast("long")
    return F.when(F.isnan(value) | (value <= float(low)), F.lit(low)).when(value >= float(high), F.lit(high)).otherwise(inner).cast("long")


def affine_box(data: DataFrame, matrix, shape, box=None, order: int = 1, fill_value: float = 0.0, bounds: tuple[int, int] | None = None) -> DataFrame:
    """(target, value) of affine_transform for a box of the output frame, slices for each axis (for all three, or the last
    two of an image; the source's extent if none); it may be larger than the source. target numbers the box in C-order.
    ``bounds`` are those of an integer type: values are rounded and kept within them."""
    axes = 2 if shape[0] == 1 else 3
    sides = list(box or [slice(None)] * axes)
    if len(sides) != axes or any(side.step is not None for side in sides):
        raise ValueError(f"a box is {axes} slices without steps")
    spans = [(side.start or 0, n if side.stop is None else side.stop) for side, n in zip(sides, shape[3 - axes :], strict=True)]
    if any(a < 0 or b < a for a, b in spans):
        raise ValueError("a box starts at 0 or later and ends no earlier than it starts")
    spans = [(0, 1)] * (3 - axes) + spans
    size = tuple(b - a for a, b in spans)
    rows = data.sparkSession.range(math.prod(size)).withColumnRenamed("id", "target")
    at = [F.col("target")] * 3 if not all(size) else coordinates(F.col("target"), size)
    targets = rows.select("target", *((c + a).alias(n) for n, c, (a, _) in zip("zyx", at, spans, strict=True)))
    out = affine_transform(data, targets, axis_rows(matrix, axes), shape, order, fill_value)
    return out if bounds is None else out.withColumn("value", to_integers(F.col("value"), *bounds))


def anti_aliasing_sigma(matrix) -> list[float]:
    """For each axis, half of what its row's length exceeds one."""
    return [max(0.0, (math.sqrt(sum(x * x for x in row[:-1])) - 1) / 2) for row in matrix]


def resample(data: DataFrame, targets: DataFrame, matrix, shape, order: int = 1, sigma=None, fill_value: float = 0.0) -> DataFrame:
    """affine_transform of the smoothed data (node_id, z, y, x, value); sigma from the matrix if none is given."""
    s = anti_aliasing_sigma(matrix) if sigma is None else list(sigma)
    smooth = gaussian_smoothing(data, shape, [x if x > 0 else 1e-2 for x in s]) if any(x > 0 for x in s) else data
    return affine_transform(smooth, targets, matrix, shape, order, fill_value)
