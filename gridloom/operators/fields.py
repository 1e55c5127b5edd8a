"""Distances on grids: exact Euclidean transforms, shortest paths, wave fronts and suppression of points."""

from __future__ import annotations

import heapq
import uuid
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import with_targets
from gridloom.functions.store import shared_folder, stored
from gridloom.plans.fronts import OWN, Grid, asked_times, by_block, note, noted, results, settled, sources


def distance_transform(pixels: DataFrame, shape, sampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """(node_id, distance float, fz, fy, fx): distance to the nearest pixel with value 0, and that pixel.

    Separable: one pass an axis, each over whole lines, which are independent. Without any zero the nearest feature is at
    -1 on the first axis.
    """
    names = ["z", "y", "x"]
    axes = [1, 2] if shape[0] == 1 else [0, 1, 2]
    zero = F.col("value") == 0
    state = pixels.select(
        "node_id", *names, F.when(zero, 0.0).otherwise(float("inf")).alias("d2"),
        *(F.when(zero, F.col(n)).otherwise(-1).cast("int").alias(f"f{n}") for n in names),
    )
    schema = "node_id long, z int, y int, x int, d2 double, fz int, fy int, fx int"
    for axis in axes:
        name, step = names[axis], float(sampling[axis])

        others = [n for k, n in enumerate(names) if k != axis]
        state = state.groupBy(*others).applyInPandas(_along(name, step), schema)
    first = names[axes[0]]
    none = F.col("d2") == float("inf")
    away = (F.col(first) + 1) * float(sampling[axes[0]])
    return state.select(
        "node_id", F.when(none, away).otherwise(F.sqrt("d2")).cast("float").alias("distance"),
        *(F.when(none, -1 if n == first else F.col(n)).otherwise(F.col(f"f{n}")).cast("int").alias(f"f{n}") for n in names),
    )


def _along(name: str, step: float):
    """One line's pass of the transform."""

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name)
        at, d2 = pdf[name].to_numpy(), pdf["d2"].to_numpy()
        some = np.flatnonzero(np.isfinite(d2))
        if not len(some):
            return pdf
        best = np.empty(len(at), dtype=np.int64)
        for k in range(0, len(at), 512):
            cost = d2[some] + ((at[k : k + 512, None] - at[some]) * step) ** 2
            best[k : k + 512] = some[cost.argmin(axis=1)]
        features = {f: pdf[f].to_numpy()[best] for f in ("fz", "fy", "fx")}
        return pdf.assign(d2=d2[best] + ((at - at[best]) * step) ** 2, **features)

    return line


def vector_difference_transform(pixels: DataFrame, shape, sampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """(node_id, vz, vy, vx): from each pixel to its nearest zero, in physical units."""
    found = distance_transform(pixels, shape, sampling).join(pixels.select("node_id", "z", "y", "x"), "node_id")
    return found.select("node_id", *(((F.col(f"f{n}") - F.col(n)) * s).cast("float").alias(f"v{n}") for n, s in zip("zyx", sampling, strict=True)))


def non_maximum_suppression(points: DataFrame) -> DataFrame:
    """Points (point_id, z, y, x, radius) that are the best of their own neighbourhood or of another's: of the points
    within a point's radius (single precision), the one of largest radius, the smaller id on ties.

    Points meet by cells as wide as the power of two over their radius: a point looks only into the cells around it, at
    its own scale.
    """
    scale = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("radius"), F.lit(1.0))))).cast("long")
    asks = points.withColumn("scale", scale)
    scales = asks.select("scale").distinct()  # at most 63 of them
    cell = lambda c: F.floor(F.col(c) / F.col("scale"))
    kept = points.crossJoin(F.broadcast(scales)).select(
        F.col("point_id").alias("other"), F.col("z").alias("oz"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("radius").alias("oradius"),
        "scale", cell("z").alias("cz"), cell("y").alias("cy"), cell("x").alias("cx"),
    )
    around = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(o, "abc", strict=True))) for o in product((-1, 0, 1), repeat=3)))
    asks = asks.withColumn("o", F.explode(around)).select(
        "point_id", "z", "y", "x", "radius", "scale",
        (cell("z") + F.col("o.a")).alias("cz"), (cell("y") + F.col("o.b")).alias("cy"), (cell("x") + F.col("o.c")).alias("cx"),
    )
    # Spark takes rows that are made here for as few as the file's: without a hint it would broadcast them.
    met = asks.join(kept.hint("merge"), ["scale", "cz", "cy", "cx"])
    d2 = sum(((F.col(n) - F.col(f"o{n}")).cast("double") ** 2 for n in "zyx"), F.lit(0.0))
    near = met.where(F.sqrt(d2).cast("float") <= F.col("radius").cast("float"))
    best = near.groupBy("point_id").agg(F.max_by("other", F.struct("oradius", -F.col("other"))).alias("best"))
    return best.select(F.col("best").alias("point_id")).distinct().join(points.hint("merge"), "point_id")


def dijkstra(n: int, moves, free: bytearray, cost: list[float], seeds) -> tuple[list[float], list[int], list[int]]:
    """(distance, hops, predecessor) of n cells: ``moves`` (stride, length) lead to free cells, at whose cost their length is
    charged. Seeds are (distance, hops, cell). Ties by cell; steps that cost nothing are counted (hops) to tell before from after."""
    dist, hops, before = [float("inf")] * n, [0] * n, [-1] * n
    for d, h, x in seeds:
        dist[x], hops[x], before[x] = d, h, x
    heap = [(d, h, x) for d, h, x in seeds]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    left = bytearray(free)
    done = bytearray(n)
    while heap:
        d, _, x = pop(heap)
        if done[x]:
            continue
        done[x], left[x] = 1, 0
        for s, w in moves:
            y = x + s
            if left[y]:
                e = d + w * cost[y]
                if e < dist[y]:
                    h = hops[x] + 1 if e == d else 0
                elif e == d == dist[y] and hops[x] + 1 < hops[y]:
                    h = hops[x] + 1
                else:
                    continue
                dist[y], hops[y], before[y] = e, h, x
                push(heap, (e, h, y))
    return dist, hops, before


def on_grid(grid: Grid, data: dict, **values) -> tuple[np.ndarray, bytearray, dict[str, list]]:
    """Places of a block's pixels, the cells that hold one, and values of the pixels by cell."""
    at = grid.places(data["block"], data["ids"])
    free = np.zeros(grid.cells, dtype=np.uint8)
    free[at] = 1
    cells = {}
    for name, value in values.items():
        cells[name] = np.ones(grid.cells)
        cells[name][at] = value
    return at, bytearray(free.tobytes()), {k: v.tolist() for k, v in cells.items()}


def seeded(grid: Grid, data: dict, at: np.ndarray, run: int, ghosts) -> list[tuple]:
    """A block's sources, at 0, and its ghosts as (*times, cell)."""
    own = at[data["source"].astype(bool)] if run == OWN else at[data["ids"] == run]
    ids, times = ghosts
    return [(0.0,) * times.shape[1] + (x,) for x in own.tolist()] + [
        (*t, x) for t, x in zip(times.tolist(), grid.places(data["block"], ids).tolist(), strict=True)
    ]


def dijkstra_blocks(pixels: DataFrame, shape, connectivity: int, spacing, mode: str):
    """(grid, packed blocks, their solver: (places, distances, hops, predecessors as node ids))."""
    if mode not in ("physical", "node", "node_physical"):
        raise ValueError(f"unknown cost mode {mode}")
    grid = Grid(shape, connectivity)
    moves = [(grid.stride(o), 1.0 if mode == "node" else float(np.sqrt(sum((d * s) ** 2 for d, s in zip(o, spacing, strict=True))))) for o in grid.steps]
    own = pixels.withColumn("source", F.col("source").cast("boolean")).withColumn("cost", F.col("cost").cast("double"))
    blocks = grid.packed(own, ("cost", "source"))

    def solve(data, run, ghosts):
        at, free, cells = on_grid(grid, data, cost=1.0 if mode == "physical" else data["cost"])
        dist, hops, before = (np.array(a) for a in dijkstra(grid.cells, moves, free, cells["cost"], seeded(grid, data, at, run, ghosts)))
        names = np.full(grid.cells, -1)
        names[at] = data["ids"]
        names[grid.places(data["block"], ghosts[0])] = ghosts[0]
        before = before[at]
        return np.stack([dist[at], hops[at]], axis=1), np.where(before >= 0, names[before], -1)

    return grid, blocks, solve


def dijkstra_distance_field(pixels: DataFrame, shape, connectivity: int = 1, spacing=(1.0, 1.0, 1.0), mode: str = "physical", predecessors: bool = False) -> DataFrame:
    """(node_id, distance) over foreground pixels (node_id, z, y, x, source, cost), or (node_id, predecessor): a source is
    its own, unreachable pixels have inf or -1. Blocks of the grid are solved until their borders agree."""
    grid, blocks, solve = dijkstra_blocks(pixels, shape, connectivity, spacing, mode)
    notes = settled(blocks, sources(blocks), lambda data, run, ghosts: solve(data, run, ghosts)[0], 2, grid.idle)

    def finish(data, ghosts):
        times, before = solve(data, OWN, ghosts)
        return pd.DataFrame({"node_id": data["ids"], "predecessor": before} if predecessors else {"node_id": data["ids"], "distance": times[:, 0]})

    return results(blocks, notes, finish, "node_id long, predecessor long" if predecessors else "node_id long, distance double", 2)


def fast_marching(n: int, axes, free: bytearray, slowness2: list[float], seeds) -> list[float]:
    """First-order arrival times at n cells: ascending upwind terms enter while the front has passed them. ``axes``: (stride,
    sampling) of each; ``slowness2``: 1 / speed^2 of the free cells; seeds: (time, cell)."""
    inf = float("inf")
    time, passed = [inf] * n, [inf] * n
    for t, x in seeds:
        time[x] = t
    heap = list(seeds)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    left = bytearray(free)
    weights = [(s, h, 1.0 / (h * h)) for s, h in axes]
    strides = [d for s, _ in axes for d in (s, -s)]
    while heap:
        t0, x = pop(heap)
        if passed[x] < inf or t0 > time[x]:
            continue
        passed[x], left[x] = t0, 0
        for d in strides:
            y = x + d
            if not left[y]:
                continue
            terms = []
            for s, h, w in weights:
                p, q = passed[y - s], passed[y + s]
                if q < p:
                    p = q
                if p < inf:
                    terms.append((p, h, w))
            if len(terms) > 1:
                terms.sort()
            a = b = c = 0.0
            best = inf
            for t, _, w in terms:
                if best <= t:
                    break
                a, b, c = a + w, b + w * t, c + w * t * t
                root = b * b - a * (c - slowness2[y])
                if root < 0:
                    break
                best = (b + root**0.5) / a
            if best < time[y]:
                time[y] = best
                push(heap, (best, y))
    return time


def geodesic_blocks(pixels: DataFrame, shape, sampling, columns: tuple[str, ...]):
    """(grid, packed blocks, their solver)."""
    grid = Grid(shape, 1)
    axes = [(s, float(h)) for s, h, p in zip(grid.strides, sampling, grid.pad, strict=True) if p]
    own = pixels.withColumn("speed", F.col("speed").cast("double"))
    blocks = grid.packed(own, ("speed", *columns))

    def solve(data, run, ghosts):
        speed = data["speed"]
        moving = speed > 0
        at, free, cells = on_grid(grid, data, slowness2=1.0 / np.where(moving, speed, 1.0) ** 2)
        for x in at[~moving].tolist():
            free[x] = 0
        return np.array(fast_marching(grid.cells, axes, free, cells["slowness2"], seeded(grid, data, at, run, ghosts)))[at]

    return grid, blocks, solve


def geodesic_distance_field(pixels: DataFrame, shape, sampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """(node_id, distance) over foreground pixels (node_id, z, y, x, source, speed): inf where the front never comes. Blocks of
    the grid are solved until their borders agree."""
    grid, blocks, solve = geodesic_blocks(pixels.withColumn("source", F.col("source").cast("boolean")), shape, sampling, ("source",))
    notes = settled(blocks, sources(blocks), solve, idle=grid.idle)

    def finish(data, ghosts):
        return pd.DataFrame({"node_id": data["ids"], "distance": solve(data, OWN, ghosts)})

    return results(blocks, notes, finish, "node_id long, distance double")


def mean_of_both_ways(points: DataFrame, one: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of points (point): the mean of one (a, b, distance) and its reverse, 0 to itself, inf without one."""
    pairs = points.select(F.col("point").alias("a")).crossJoin(points.select(F.col("point").alias("b")))  # the result's own rows
    pairs = pairs.join(one, ["a", "b"], "left").join(one.toDF("b", "a", "back"), ["a", "b"], "left")
    mean = (F.col("distance") + F.col("back")) / 2
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce(mean, F.lit(float("inf")))).alias("distance"))


def geodesic_distances(pixels: DataFrame, points: DataFrame, shape, sampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """(a, b, distance) between points (point_id, node_id), the mean of both directions, 0 to itself, inf between components.
    One front a point, all in the same rounds: a task holds a block and, one after the other, the fronts in it."""
    at = points.select(F.col("node_id").alias("n")).distinct()
    marked = pixels.join(at, F.col("node_id") == F.col("n"), "left").withColumn("asked", F.col("n").isNotNull()).drop("n")
    grid, blocks, solve = geodesic_blocks(marked, shape, sampling, ("asked",))
    begin = marked.where("asked").select(F.col("node_id").cast("long").alias("run"), grid.block_of(F.col("z"), F.col("y"), F.col("x")).alias("block"))
    one = stored(asked_times(settled(blocks, begin, solve, idle=grid.idle), pixels.sparkSession))
    named = points.select("point_id", "node_id")
    met = one.join(named.toDF("a", "from"), "from").join(named.toDF("b", "to"), "to").select("a", "b", "distance")
    return mean_of_both_ways(points.select(F.col("point_id").alias("point")), met)


def dijkstra_path(pixels: DataFrame, shape, target, connectivity: int = 1, spacing=(1.0, 1.0, 1.0), mode: str = "physical") -> DataFrame:
    """(step, node_id): the cheapest path from a source to the target, or to the cheapest of a list of targets (ties by node
    id), along predecessors; an error if there is none. The walk goes from block to block, a task each."""
    spark = pixels.sparkSession
    wanted = [target] if isinstance(target, int) else list(target)
    grid, blocks, solve = dijkstra_blocks(pixels, shape, connectivity, spacing, mode)
    notes = settled(blocks, sources(blocks), lambda data, run, ghosts: solve(data, run, ghosts)[0], 2, grid.idle)

    def finish(data, ghosts):
        """A block's predecessors as one row, and a row for each target that is reached."""
        times, before = solve(data, OWN, ghosts)
        rows = [(data["block"], note(data["ids"], before), None, None)]
        for k in np.flatnonzero(np.isin(data["ids"], wanted) & (before >= 0)).tolist():
            rows.append((data["block"], None, float(times[k, 0]), int(data["ids"][k])))
        return pd.DataFrame(rows, columns=["block", "data", "total", "goal"]).astype({"goal": "Int64"})

    found = by_block(results(blocks, notes, finish, "block long, data binary, total double, goal long", 2))
    best = found.where("goal IS NOT NULL").agg(F.min(F.struct("total", "goal"))).first()[0]
    if best is None:
        raise ValueError(f"no path to {target}")
    path, schema = f"{shared_folder(spark)}/{uuid.uuid4().hex}", "back long, node_id long, next long"
    node, back = best["goal"], 0
    while node is not None:
        block = int(grid.blocks_at(grid.split(np.array([node])))[0])

        def walk(batches, node=node, back=back):
            for pdf in batches:
                for data in pdf["data"]:
                    ids, before = (a.astype(np.int64).ravel() for a in noted([data], 1))
                    steps, at, to = [], node, None
                    while True:
                        k = int(np.searchsorted(ids, at))
                        if k == len(ids) or ids[k] != at:
                            to = at
                            break
                        steps.append(at)
                        if before[k] == at:
                            break
                        at = int(before[k])
                    next_ = pd.array([None] * (len(steps) - 1) + [to], dtype="Int64")
                    yield pd.DataFrame({"back": back + np.arange(len(steps)), "node_id": steps, "next": next_})

        rows = found.where((F.col("block") == block) & F.col("data").isNotNull()).select("data")
        rows.mapInPandas(walk, schema).write.mode("append").parquet(path)
        ahead = spark.read.schema(schema).parquet(path).agg(F.max_by("next", "back"), F.max("back")).first()
        node, back = ahead[0], ahead[1] + 1
    return spark.read.schema(schema).parquet(path).select((F.lit(back - 1) - F.col("back")).alias("step"), "node_id")


def geodesic_gradient(field: DataFrame, pixels: DataFrame, shape, sampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """(node_id, gz, gy, gx): one-sided differences of a field (node_id, distance) towards the smaller neighbour along each
    axis, 0 where none is smaller or the field is not finite."""
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    own = pixels.select("node_id", "z", "y", "x").join(field, "node_id")
    near = with_targets(own, steps, shape).join(field.toDF("to", "other"), "to")
    axis = F.call_function("div", F.col("channel"), F.lit(2))
    rows = near.groupBy("node_id", axis.alias("axis")).agg(
        F.min_by(F.when(F.col("channel") % 2 == 0, 1.0).otherwise(-1.0), "other").alias("side"), F.min("other").alias("other")
    )
    rows = rows.join(field, "node_id").where("other < distance AND distance < double('infinity')")
    slope = F.col("side") * (F.col("other") - F.col("distance"))
    parts = rows.groupBy("node_id").agg(*(F.max(F.when(F.col("axis") == k, slope / float(s))).alias(f"g{n}") for k, (n, s) in enumerate(zip("zyx", sampling, strict=True))))
    return field.select("node_id").join(parts, "node_id", "left").select("node_id", *(F.coalesce(f"g{n}", F.lit(0.0)).cast("float").alias(f"g{n}") for n in "zyx"))
