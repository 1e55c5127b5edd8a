"""Fronts by small blocks against naive ones over the undivided grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields, flow, meshfields
from gridloom.plans import fronts


@pytest.fixture
def case(spark):
    """A maze of 13 x 6 pixels whose ways go back and forth between blocks; some cost nothing."""
    rng = np.random.default_rng(5)
    h, w = 13, 6
    keep = rng.random((h, w)) > 0.25
    keep[0, 0] = keep[12, 5] = True
    cost = rng.integers(0, 4, (h, w)).astype(float)
    rows = [(y * w + x, 0, y, x, y * w + x == 0, float(cost[y, x]), 1.0 + float(cost[y, x])) for y, x in np.argwhere(keep).tolist()]
    return spark.createDataFrame(rows, "node_id long, z int, y int, x int, source boolean, cost double, speed double"), (1, h, w), keep, cost


def relaxed(keep, cost):
    """Cheapest ways from pixel 0 over eight neighbours, at the cost of the pixels entered."""
    dist = np.full(keep.shape, np.inf)
    dist[0, 0] = 0
    for _ in range(keep.size):
        for y, x in np.argwhere(keep & np.isfinite(dist)).tolist():
            for b, a in ((y + p, x + q) for p in (-1, 0, 1) for q in (-1, 0, 1)):
                if 0 <= b < keep.shape[0] and 0 <= a < keep.shape[1] and keep[b, a]:
                    dist[b, a] = min(dist[b, a], dist[y, x] + cost[b, a])
    return dist


@pytest.mark.parametrize("size", [16])
def test_ways_through_blocks(case, monkeypatch, size):
    """No task has more than ``size`` pixels, whatever the size of a component."""
    monkeypatch.setattr(fronts, "SIZE", size)
    px, shape, keep, cost = case
    want = relaxed(keep, cost)
    got = {r["node_id"]: r["distance"] for r in fields.dijkstra_distance_field(px, shape, 2, mode="node").collect()}
    assert got == {y * 6 + x: want[y, x] for y, x in np.argwhere(keep).tolist()}
    before = {r["node_id"]: r["predecessor"] for r in fields.dijkstra_distance_field(px, shape, 2, mode="node", predecessors=True).collect()}
    for start in before:
        seen, at = set(), start
        while before[at] not in (at, -1):  # no circle among pixels that cost nothing
            assert at not in seen and got[at] == got[before[at]] + cost[at // 6, at % 6]
            seen.add(at)
            at = before[at]
        assert (at == 0) == np.isfinite(got[start])
    walk = [r["node_id"] for r in fields.dijkstra_path(px, shape, [77], 2, mode="node").orderBy("step").collect()]
    assert walk[0] == 0 and walk[-1] == 77 and all(before[b] == a for a, b in zip(walk, walk[1:], strict=False))


def test_fronts_through_blocks(case, monkeypatch):
    px, shape, _, _ = case
    field = lambda: {r["node_id"]: r["distance"] for r in fields.geodesic_distance_field(px, shape, (1.0, 2.0, 0.5)).collect()}
    points = px.where("node_id % 7 = 0").select((F.col("node_id") + 100).alias("point_id"), "node_id")
    between = lambda: {(r["a"], r["b"]): r["distance"] for r in fields.geodesic_distances(px, points, shape).collect()}
    whole, all_pairs = field(), between()
    monkeypatch.setattr(fronts, "SIZE", 20)
    assert field() == whole and between() == all_pairs
    assert len({d for d in all_pairs.values() if np.isfinite(d)}) > 2


def test_fronts_through_blocks_of_a_mesh(spark, monkeypatch):
    """As from one block, whatever the order of the ids."""
    rng = np.random.default_rng(2)
    name = rng.permutation(42).reshape(7, 6)
    v = spark.createDataFrame(
        [(int(name[y, x]), float(rng.random()), float(y), float(x), y + x == 0, float(rng.random() + 0.5), y % 3 == 0 and x == 5) for y in range(7) for x in range(6)],
        "vertex_id long, z double, y double, x double, source boolean, speed double, asked boolean",
    )
    faces = [t for y in range(6) for x in range(5) for t in ((name[y, x], name[y, x + 1], name[y + 1, x]), (name[y, x + 1], name[y + 1, x], name[y + 1, x + 1]))]
    f = spark.createDataFrame([tuple(map(int, t)) for t in faces], "a long, b long, c long")
    field = lambda: {r["vertex_id"]: r["distance"] for r in meshfields.geodesic_distance_field_mesh(v, f).collect()}
    between = lambda: {(r["a"], r["b"]): r["distance"] for r in meshfields.geodesic_distances_mesh(v, f, v.where("asked").select("vertex_id")).collect()}
    whole, pairs = field(), between()
    monkeypatch.setattr(fronts, "SIZE", 15)
    assert field() == pytest.approx(whole, abs=1e-12) and between() == pytest.approx(pairs, abs=1e-12) and len(pairs) == 9


def test_particles_through_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(y * 6 + x, 0, y, x, bool(rng.random() > 0.2), 0.0, float(rng.normal()), float(rng.normal())) for y in range(40) for x in range(6)]
    px = spark.createDataFrame(rows, "node_id long, z int, y int, x int, fg boolean, fz double, fy double, fx double")
    density = lambda: {r["node_id"]: r["density"] for r in flow.flow_density(px, (1, 40, 6), steps=6).collect()}
    whole = density()
    monkeypatch.setattr(fronts, "SIZE", 40)
    assert density() == whole and sum(whole.values()) == sum(r[4] for r in rows)
