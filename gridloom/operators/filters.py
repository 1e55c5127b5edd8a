"""Separable Gaussian filters and their derivatives on grids, as one pass along each axis.

A pass sends each pixel to the pixels under the kernel, which are a literal list of taps, and sums by target: one
pre-aggregated shuffle an axis, whatever the kernel's width. Borders are mirrored without repeating the edge.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import full, node_id


def kernel(sigma: float, order: int = 0, window_size: float = 0.0) -> list[float]:
    """Taps from -radius to radius: order 0 sums to 1; order 1 has sum(k * h) = 0.5 by half the taps, that is slope one;
    order 2 sums to 0 and has half its second moment 1."""
    if sigma <= 0 or order not in (0, 1, 2):
        raise ValueError("sigma must be positive and the order 0, 1 or 2")
    radius = max(1, math.ceil((window_size if window_size > 0 else 3 + 0.5 * order) * sigma))
    at = range(-radius, radius + 1)
    g = [math.exp(-0.5 * (k / sigma) ** 2) for k in at]
    if order == 0:
        total = sum(g)
        return single(x / total for x in g)
    if order == 1:
        h = [-k * x for k, x in zip(at, g, strict=True)]
        slope = -sum(k * x for k, x in zip(at, h, strict=True))
        return single(x / slope for x in h)
    h = [(k * k / sigma**2 - 1) * x for k, x in zip(at, g, strict=True)]
    mean = sum(h) / len(h)
    h = [x - mean for x in h]
    moment = 0.5 * sum(k * k * x for k, x in zip(at, h, strict=True))
    return single(x / moment for x in h)


def single(taps) -> list[float]:
    """Taps as single-precision numbers."""
    return [struct.unpack("f", struct.pack("f", x))[0] for x in taps]


def convolve(pixels: DataFrame, shape, axis: int, taps: list[float], value: str = "value") -> DataFrame:
    """(node_id, z, y, x, value): one pass along an axis, out[p] = sum of taps[k] * in[p - k].

    Mirrored borders are read backwards: a pixel goes to every target whose mirrored source it is, which are its taps'
    targets around itself and around its mirror images at both ends.
    """
    n, r = shape[axis], len(taps) // 2
    name = ("z", "y", "x")[axis]
    c = F.col(name)
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-r, r + 1), taps, strict=True)))
    if n == 1:
        return pixels.select("node_id", "z", "y", "x", (F.col(value) * sum(taps)).alias("value"))
    period = 2 * (n - 1)
    images = F.array(*(img for j in range(-(r // period) - 1, r // period + 2) for img in (c + j * period, j * period - c)))
    sent = pixels.select("z", "y", "x", F.col(value).alias("v_"), F.explode(F.array_distinct(images)).alias("image"))
    sent = sent.where((F.col("image") >= -r) & (F.col("image") <= n - 1 + r))
    sent = sent.select("z", "y", "x", "v_", "image", F.explode(entries).alias("e"))
    sent = sent.withColumn(name, (F.col("image") + F.col("e.k")).cast("int")).where((c >= 0) & (c < n))
    return (
        sent.groupBy("z", "y", "x").agg(F.sum(F.col("v_") * F.col("e.w")).alias("value"))
        .select(node_id(F.col("z"), F.col("y"), F.col("x"), shape).alias("node_id"), "z", "y", "x", "value")
    )


def _axes(shape) -> list[int]:
    return [1, 2] if shape[0] == 1 else [0, 1, 2]


def _per_axis(x, shape) -> dict[int, float]:
    axes = _axes(shape)
    return dict(zip(axes, x if isinstance(x, list | tuple) else [x] * len(axes), strict=True))


def gaussian_derivative(pixels: DataFrame, shape, sigma, order, window_size: float = 0.0) -> DataFrame:
    """sigma and order: one number, or one for each axis."""
    shape = full(shape[1:] if len(shape) == 3 and shape[0] == 1 else shape)
    s, o = _per_axis(sigma, shape), _per_axis(order, shape)
    out = pixels
    for axis in _axes(shape):
        out = convolve(out, shape, axis, kernel(s[axis], int(o[axis]), window_size))
    return out


def gaussian_smoothing(pixels: DataFrame, shape, sigma, window_size: float = 0.0) -> DataFrame:
    return gaussian_derivative(pixels, shape, sigma, 0, window_size)


def _parts(pixels: DataFrame, shape, sigma, orders: list[list[int]]) -> DataFrame:
    """(node_id, d0, d1, ...) of several derivatives."""
    out = None
    for k, order in enumerate(orders):
        part = gaussian_derivative(pixels, shape, sigma, order).select("node_id", F.col("value").alias(f"d{k}"))
        out = part if out is None else out.join(part, "node_id")
    return out


def _unit(shape, *axes: int) -> list[int]:
    return [sum(a == b for b in axes) for a in _axes(shape)]


def gaussian_gradient_magnitude(pixels: DataFrame, shape, sigma) -> DataFrame:
    axes = _axes(shape)
    parts = _parts(pixels, shape, sigma, [_unit(shape, a) for a in axes])
    return parts.select("node_id", F.sqrt(sum((F.col(f"d{k}") ** 2 for k in range(len(axes))), F.lit(0.0))).alias("value"))


def laplacian_of_gaussian(pixels: DataFrame, shape, sigma) -> DataFrame:
    axes = _axes(shape)
    parts = _parts(pixels, shape, sigma, [_unit(shape, a, a) for a in axes])
    return parts.select("node_id", sum((F.col(f"d{k}") for k in range(len(axes))), F.lit(0.0)).alias("value"))


def eigenvalues(m: dict[tuple[int, int], Column], n: int) -> list[Column]:
    """Eigenvalues of a symmetric 2 x 2 or 3 x 3 matrix, largest first."""
    if n == 2:
        half, diff = (m[0, 0] + m[1, 1]) / 2, (m[0, 0] - m[1, 1]) / 2
        root = F.sqrt(diff * diff + m[0, 1] * m[0, 1])
        return [half + root, half - root]
    q = (m[0, 0] + m[1, 1] + m[2, 2]) / 3
    off = m[0, 1] ** 2 + m[0, 2] ** 2 + m[1, 2] ** 2
    p = F.sqrt(((m[0, 0] - q) ** 2 + (m[1, 1] - q) ** 2 + (m[2, 2] - q) ** 2 + 2 * off) / 6)
    a, b, c = ((m[k, k] - q) for k in range(3))
    det = a * (b * c - m[1, 2] ** 2) - m[0, 1] * (m[0, 1] * c - m[1, 2] * m[0, 2]) + m[0, 2] * (m[0, 1] * m[1, 2] - b * m[0, 2])
    r = F.least(F.greatest(F.when(p > 0, det / (2 * p * p * p)).otherwise(0.0), F.lit(-1.0)), F.lit(1.0))
    phi = F.acos(r) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [first, 3 * q - first - last, last]


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def hessian_eigenvalues(pixels: DataFrame, shape, sigma) -> DataFrame:
    """(node_id, e0, e1[, e2]) descending."""
    axes = _axes(shape)
    pairs = _pairs(len(axes))
    parts = _parts(pixels, shape, sigma, [_unit(shape, axes[i], axes[j]) for i, j in pairs])
    ev = eigenvalues({p: F.col(f"d{k}") for k, p in enumerate(pairs)}, len(axes))
    return parts.select("node_id", *(e.alias(f"e{k}") for k, e in enumerate(ev)))


def structure_tensor_eigenvalues(pixels: DataFrame, shape, inner_sigma, outer_sigma) -> DataFrame:
    """(node_id, e0, e1[, e2]) descending, of the smoothed products of first derivatives."""
    axes = _axes(shape)
    pairs = _pairs(len(axes))
    slopes = _parts(pixels, shape, inner_sigma, [_unit(shape, a) for a in axes]).join(pixels.select("node_id", "z", "y", "x"), "node_id")
    out = None
    for k, (i, j) in enumerate(pairs):
        product = slopes.select("node_id", "z", "y", "x", (F.col(f"d{i}") * F.col(f"d{j}")).alias("value"))
        part = gaussian_smoothing(product, shape, outer_sigma).select("node_id", F.col("value").alias(f"m{k}"))
        out = part if out is None else out.join(part, "node_id")
    ev = eigenvalues({p: F.col(f"m{k}") for k, p in enumerate(pairs)}, len(axes))
    return out.select("node_id", *(e.alias(f"e{k}") for k, e in enumerate(ev)))

