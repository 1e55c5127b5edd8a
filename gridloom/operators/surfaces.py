"""Isosurfaces of grids: marching cubes as expressions over cells, with triangle lists built by rule.

A cell's corners are numbered by bits (z, y, x); its edges are (axis, low corner). On each face, seen from outside and run
through counter-clockwise, the contour goes from where the walk leaves the inside to where it last entered it. Each edge
that is crossed is left in just one of its two faces, so these steps close to loops, which are cut into triangles without a cut
across a face of the cell, which the cell beyond could make too. On faces with two inside corners across, each corner is cut
off by itself; both cells of a face see it alike, so the surface is closed.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import node_id
from gridloom.functions.store import row_numbers, stored

#: Bit of each axis in a corner's number.
BITS = (4, 2, 1)


def edge_number(a: int, b: int) -> int:
    """Number of the edge between two corners: axis * 4 + rank of its low corner among those of the axis."""
    bit = a ^ b
    axis, low = BITS.index(bit), min(a, b)
    return axis * 4 + [c for c in range(8) if not c & bit].index(low)


def edge_ends(e: int) -> tuple[int, int, int]:
    """(axis, low corner, high corner)."""
    axis = e // 4
    low = [c for c in range(8) if not c & BITS[axis]][e % 4]
    return axis, low, low | BITS[axis]


def faces() -> list[list[int]]:
    """Corners of the six faces, counter-clockwise from outside (axes z, y, x right-handed)."""
    out = []
    for axis in range(3):
        p, q = BITS[(axis + 1) % 3], BITS[(axis + 2) % 3]
        for side in (0, 1):
            base = BITS[axis] * side
            walk = [base, base | p, base | p | q, base | q]
            out.append(walk if side else walk[::-1])
    return out


def on_one_face(e: int, f: int) -> bool:
    """Are two edges on a common face of the cell?"""
    (axis, low, _), (other, low_f, _) = edge_ends(e), edge_ends(f)
    return any(k not in (axis, other) and not (low ^ low_f) & BITS[k] for k in range(3))


def cut(loop: list[int]) -> list[tuple[int, int, int]]:
    """Triangles of a loop of edges, with as few cuts between edges of one face as there can be (the first such way)."""

    @lru_cache(maxsize=None)
    def best(i: int, j: int) -> tuple[int, tuple]:
        if j - i < 2:
            return 0, ()
        ways = []
        for k in range(i + 1, j):
            bad = sum(on_one_face(loop[a], loop[b]) for a, b in ((i, k), (k, j)) if b - a > 1)
            (m, left), (n, right) = best(i, k), best(k, j)
            ways.append((m + n + bad, left + ((loop[i], loop[k], loop[j]),) + right))
        return min(ways, key=lambda w: w[0])

    return list(best(0, len(loop) - 1)[1])


@lru_cache(maxsize=1)
def triangles() -> list[list[tuple[int, int, int]]]:
    """Triangles (three edge numbers) of each of the 256 cases; bit k of a case: corner k is inside."""
    out = []
    for case in range(256):
        follow: dict[int, int] = {}
        for walk in faces():
            inside = [case >> c & 1 for c in walk]
            for k in range(4):
                if inside[k] and not inside[(k + 1) % 4]:  # leaves here; entered at the start of this run of corners
                    j = k
                    while inside[(j - 1) % 4] and (j - 1) % 4 != k:
                        j = (j - 1) % 4
                    follow[edge_number(walk[k], walk[(k + 1) % 4])] = edge_number(walk[(j - 1) % 4], walk[j])
        found, left = [], dict(follow)
        while left:
            start, e = next(iter(left.items()))
            loop = [start]
            del left[start]
            while e != start:
                loop.append(e)
                e = left.pop(e)
            found += cut(loop)
        out.append(found)
    return out


def marching_cubes(pixels: DataFrame, shape, level: float | None = None, spacing=(1.0, 1.0, 1.0), ascent: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices (vertex_id, z, y, x), faces (a, b, c)) of the surface value = level in pixels (node_id, z, y, x, value);
    the mid-range if no level is given. Values above the level are inside; faces turn towards smaller values, or, for
    ``ascent``, towards larger ones. A level that nothing crosses is an error.

    A pixel goes to the up to eight cells that it is a corner of: one pre-aggregated shuffle. Vertices on an edge that
    several cells share have one key, the lower pixel and the axis.
    """
    if level is None:
        low, high = pixels.agg(F.min("value"), F.max("value")).first()
        level = (low + high) / 2
    corners = F.array(*(F.struct(*(F.lit(c >> s & 1).alias(n) for s, n in zip((2, 1, 0), "zyx", strict=True)), F.lit(c).alias("k")) for c in range(8)))
    sent = pixels.withColumn("o", F.explode(corners))
    z, y, x = (F.col(n) - F.col(f"o.{n}") for n in "zyx")
    fits = (z >= 0) & (y >= 0) & (x >= 0) & (z < shape[0] - 1) & (y < shape[1] - 1) & (x < shape[2] - 1)
    sent = sent.where(fits).select(z.alias("z"), y.alias("y"), x.alias("x"), F.col("o.k").alias("k"), F.col("value").cast("double").alias("value"))
    values = [F.max(F.when(F.col("k") == c, F.col("value"))).alias(f"v{c}") for c in range(8)]
    cells = sent.groupBy("z", "y", "x").agg(*values)
    case = sum(((F.col(f"v{c}") > level).cast("int") * (1 << c) for c in range(8)), F.lit(0))
    turned = [[(a, b, c) if ascent else (a, c, b) for a, b, c in t] for t in triangles()]
    lists = F.array(*(F.array(*(F.lit(e) for tri in t for e in tri)) if t else F.array().cast("array<int>") for t in turned))
    crossed = cells.withColumn("case", case).where("case > 0 AND case < 255")
    used = stored(crossed.withColumn("list", F.element_at(lists, F.col("case") + 1)).drop("case"))

    ends = [edge_ends(e) for e in range(12)]

    def key(e: int):
        axis, low, _ = ends[e]
        dz, dy, dx = (low >> s & 1 for s in (2, 1, 0))
        return node_id(F.col("z") + dz, F.col("y") + dy, F.col("x") + dx, shape) * 3 + axis

    keys = F.array(*(key(e) for e in range(12)))
    corner = F.posexplode(F.transform("list", lambda e: F.element_at(keys, e + 1))).alias("at", "key")
    cell = node_id(F.col("z"), F.col("y"), F.col("x"), shape).alias("cell")
    uses = used.select(cell, corner)

    def point(e: int):
        axis, low, high = ends[e]
        t = (F.lit(level) - F.col(f"v{low}")) / (F.col(f"v{high}") - F.col(f"v{low}"))
        parts = []
        for k, n in enumerate("zyx"):
            c = F.col(n) + float(low >> (2 - k) & 1)
            parts.append(((c + t if k == axis else c) * float(spacing[k])).alias(n))
        crossed_here = (F.col(f"v{low}") > level) != (F.col(f"v{high}") > level)
        return F.when(crossed_here, F.struct(key(e).alias("key"), *parts))

    points = used.select(F.explode(F.array(*(point(e) for e in range(12)))).alias("p")).where("p IS NOT NULL")
    unique = points.groupBy("p.key").agg(*(F.min(f"p.{n}").alias(n) for n in "zyx"))
    vertices = stored(row_numbers(unique, ["key"], "vertex_id"))
    if vertices.isEmpty():
        raise RuntimeError(f"no surface at {level}")
    named = uses.join(vertices.select("key", "vertex_id"), "key")
    tri = named.groupBy("cell", F.expr("at div 3").alias("t")).agg(
        *(F.max(F.when(F.col("at") % 3 == k, F.col("vertex_id"))).alias(n) for k, n in enumerate("abc"))
    )
    return vertices.select("vertex_id", "z", "y", "x"), tri.select("a", "b", "c")
