"""Golden values on tiny inputs, naive versions, and divided against undivided graphs."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import full
from gridloom.functions.store import row_numbers
from gridloom.operators import affinities, fields, filaments, filters, flow, graphs, gridgraph, kernels, meshes, meshfields, multiset, overlap, partition, rag, skeletons, surfaces, warp
from gridloom.operators.blocking import Blocking
from gridloom.plans.solve import solve


def image(spark, labels, **more):
    a = np.asarray(labels)
    vol = a.reshape((1, *a.shape)) if a.ndim == 2 else a
    rows, names = [], ["node_id", "z", "y", "x", "label", *more]
    extra = {k: np.asarray(v).reshape(vol.shape) for k, v in more.items()}
    for k, (z, y, x) in enumerate(np.ndindex(vol.shape)):
        rows.append((k, z, y, x, int(vol[z, y, x]), *(v[z, y, x].item() for v in extra.values())))
    kinds = {"node_id": "long", "z": "int", "y": "int", "x": "int", "label": "long"}
    for k, v in extra.items():
        kinds[k] = "double" if v.dtype.kind == "f" else "boolean" if v.dtype.kind == "b" else "long"
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names)), full(a.shape)


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def edge_table(spark, rows, schema="edge_id long, u long, v long, cost double"):
    return spark.createDataFrame(rows, schema)


def node_table(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def labels_of(df):
    return [r["label"] for r in df.orderBy("node").collect()]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_rag(spark):
    px, shape = image(spark, [[1, 1, 2], [1, 3, 2], [4, 3, 3]])
    edges = rag.region_adjacency_graph(px, shape)
    assert table(edges, "edge_id", "u", "v") == [(0, 1, 2), (1, 1, 3), (2, 1, 4), (3, 2, 3), (4, 3, 4)]
    coords = rag.rag_coordinates(px, shape, edges)
    assert table(rag.storage_lengths(coords), "edge_id", "length") == [(0, 2), (1, 4), (2, 2), (3, 4), (4, 2)]
    assert table(coords.where("edge_id = 1 AND side = 1"), "node_id") == [(1,), (3,)]
    found = graphs.find_edges(edges, spark.createDataFrame([(3, 1), (1, 1), (2, 4)], "u long, v long"))
    assert table(found, "u", "v", "edge_id") == [(1, 1, -1), (2, 4, -1), (3, 1, 1)]
    with pytest.raises(Exception, match="negative"):
        bad, s = image(spark, [[-1, 1]])
        rag.region_adjacency_graph(bad, s).collect()


def test_edge_map_features(spark):
    px, shape = image(spark, [[1, 1, 2], [1, 3, 2]], value=[[1.0, 2, 10], [3, 4, 20]])
    assert table(rag.edge_map_features(px, shape), "mean", "size") == [(3.25, 2), (6.0, 1), (12.0, 1)]
    row = [r for r in rag.edge_map_features(px, shape, full=True).collect() if (r["u"], r["v"]) == (1, 3)][0]
    want = dict(median=3.25, std=0.25, min=3, max=3.5, p5=3.025, p10=3.05, p25=3.125, p75=3.375, p90=3.45, p95=3.475)
    assert all(abs(row[k] - v) < 1e-12 for k, v in want.items())


def test_affinity_features(spark):
    px, shape = image(spark, [[1, 1, 2], [1, 3, 2]])
    values = np.array([[[0, 6, 0], [7, 8, 0]], [[0, 9, 0], [0, 0, 0]]], float)
    affs = spark.createDataFrame([(c, k, float(values[c].flat[k])) for c in (0, 1) for k in range(6)], "channel int, node_id long, affinity double")
    edges = rag.region_adjacency_graph(px, shape)
    assert table(rag.affinity_features(edges, px, affs, [(0, 1), (1, 0)], shape), "mean", "size") == [(6.0, 1), (8.0, 1), (8.0, 2)]


def test_merge_of_partial_statistics(spark):
    rng = np.random.default_rng(1)
    big = 1e8 + rng.integers(0, 2, (12, 12)).astype(float)
    px, shape = image(spark, np.arange(144).reshape(12, 12) // 24, value=big)
    edges = rag.region_adjacency_graph(px, shape)
    stats = rag.block_edge_stats(rag.edge_map_values(px, shape), px, shape, (1, 3, 5))
    got = rag.finalize_edge_features(rag.merge_edge_stats(edges, stats), full=True)
    want = rag.edge_map_features(px, shape, full=True)
    for a, b in zip(got.orderBy("u", "v").collect(), want.orderBy("u", "v").collect(), strict=True):
        assert a["size"] == b["size"] and all(abs(a[c] - b[c]) < 1e-6 for c in ("mean", "std", "min", "max"))
    pairs = spark.createDataFrame([(3, 1), (1, 3), (0, 2), (2, 0), (4, 4), (5, 6)], "u long, v long")
    assert table(rag.merge_edges(pairs), "u", "v") == [(0, 2), (1, 3), (5, 6)]


def test_lifted_edges(spark):
    quad = np.kron([[0, 1], [2, 3]], np.ones((2, 2), int))
    px, shape = image(spark, quad)
    edges = rag.region_adjacency_graph(px, shape)
    assert table(rag.lifted_edges(edges, px, [(0, 1), (2, 2)], shape), "u", "v") == [(0, 3)]
    assert table(rag.lifted_edges(edges, px, [(2, -2)], shape), "u", "v") == [(1, 2)]


def test_grid_graph(spark):
    px, shape = image(spark, np.zeros((2, 3), int), value=[[0.0, 2, 4], [10, 12, 14]])
    assert [r["weight"] for r in gridgraph.grid_boundary_features(px, shape).orderBy("edge_id").collect()] == [5, 7, 9, 1, 3, 11, 13]
    affs = spark.createDataFrame([(c, k, float(10 * (c + 1) + k)) for c in (0, 1) for k in range(6)], "channel int, node_id long, affinity double")
    got = gridgraph.grid_affinity_features(spark, affs, [(1, 0), (0, 1)], shape).orderBy("edge_id").collect()
    assert [r["weight"] for r in got] == [10, 11, 12, 20, 21, 23, 24]
    with pytest.raises(ValueError):
        gridgraph.grid_affinity_features(spark, affs, [(1, 0), (-1, 0)], shape)
    vol = (3, 4, 5)
    edges = gridgraph.grid_edges(spark, vol).collect()
    ids = np.arange(60).reshape(vol)
    want = {(int(a), int(b)) for ax in range(3) for a, b in zip(np.delete(ids, -1, ax).ravel(), np.delete(ids, 0, ax).ravel(), strict=True)}
    assert {(r["u"], r["v"]) for r in edges} == want and len(edges) == len(want)


def test_accumulate_labels(spark):
    px, _ = image(spark, [[1, 1, 2], [3, 2, 2]], other=[[7, 7, 8], [9, 8, 8]])
    assert table(rag.accumulate_labels(px), "label", "majority") == [(1, 7), (2, 8), (3, 9)]
    px, _ = image(spark, [[1, 1]], other=[[5, 3]])
    assert table(rag.accumulate_labels(px), "label", "majority") == [(1, 3)]
    px, _ = image(spark, [[1, 1, 2], [3, 2, 2]], other=[[0, 0, 0], [9, 8, 8]])
    assert table(rag.accumulate_labels(px, ignore_value=0), "label", "majority") == [(1, 0), (2, 8), (3, 9)]


def test_overlap(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 2, 1, 3, 2], [5, 5, 5, 6, 6, 7], strict=True)), "label_a long, label_b long")
    t = overlap.segmentation_overlap(rows)
    assert table(t, "label_a", "label_b", "count") == [(1, 5, 2), (1, 6, 1), (2, 5, 1), (2, 7, 1), (3, 6, 1)]
    assert table(overlap.best_overlap(t).where("label = 1"), "best", "count") == [(5, 2)]
    rows = spark.createDataFrame(list(zip([1, 1, 2, 2, 3], [0, 5, 0, 6, 6], strict=True)), "label_a long, label_b long")
    t = overlap.segmentation_overlap(rows)
    assert table(overlap.best_overlap(t).where("label = 1"), "best") == [(0,)]
    assert table(overlap.best_overlap(t, ignore_zero=True).where("label = 1"), "best") == [(5,)]
    assert table(overlap.different_overlap(t, spark.createDataFrame([(1, 2)], "u long, v long")), "different") == [(0.75,)]
    with pytest.raises(Exception, match="unknown label"):
        overlap.different_overlap(t, spark.createDataFrame([(1, 9)], "u long, v long")).collect()
    with pytest.raises(Exception, match="not a key"):
        overlap.take_dict(rows, spark.createDataFrame([(1, 2)], "key long, value long"), "label_a").collect()


@pytest.mark.parametrize("bits, want", [([0, 0, 1, 1, 1, 0, 0, 1, 1], [2, 3, 2, 2]), ([1, 1, 0, 1], [0, 2, 1, 1]), ([1], [0, 1]), ([0], [1]), ([], [])])
def test_run_lengths(spark, bits, want):
    rows = spark.createDataFrame([(k, bool(b)) for k, b in enumerate(bits)], "node_id long, mask boolean")
    assert [r["length"] for r in overlap.run_lengths(rows, span=3).orderBy("run").collect()] == want


def test_relabel(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([0, 5, 10, 5, 0, 200])], "node_id long, label long")
    out, forward = overlap.relabel_sequential(rows)
    assert [r["relabeled"] for r in out.orderBy("node_id").collect()] == [0, 1, 2, 1, 0, 3]
    assert table(forward, "label", "relabeled") == [(5, 1), (10, 2), (200, 3)]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = row_numbers(df.repartition(7), ["k"], "n", 3).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(3, 1003))


def test_multiset(spark):
    a = np.zeros((4, 4), int)
    a[3, 3] = 1
    px, shape = image(spark, a)
    h = multiset.histograms(px, shape, (1, 4, 4))
    assert table(multiset.top_ids(h, 1), "id", "count") == [(0, 15)]
    blocks, entries = multiset.encode(multiset.histograms(px, shape, (1, 2, 2)))
    assert table(blocks, "block_id", "argmax", "entry_id") == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 1)]
    store = spark.createDataFrame([(0, [(1, 3), (2, 4)])], "entry_id long, entry array<struct<id:long,count:long>>")
    batch = spark.createDataFrame([(0, [(1, 3), (2, 4)]), (1, [(9, 11)])], "entry_id long, entry array<struct<id:long,count:long>>")
    merged = multiset.merge_entries(store, batch)
    assert merged.count() == 2 and table(multiset.batch_offsets(merged, batch), "old_id", "entry_id") == [(0, 0), (1, 1)]


def test_blocking(spark):
    b = Blocking((0, 0), (10, 7), (4, 3))
    assert b.per_axis == (3, 3)
    row = b.blocks(spark).where("block_id = 5").first()
    assert row["begin"] == [4, 6] and row["end"] == [8, 7]
    four = spark.range(1).select(F.lit(4).cast("long").alias("b"))
    got = four.select(*(b.neighbor(F.col("b"), axis, low).alias(f"{axis}{low}") for axis in (0, 1) for low in (True, False))).first()
    assert list(got) == [1, 7, 3, 5]
    s = Blocking((10, 20), (20, 31), (4, 5), (2, 1))
    row = s.blocks(spark).where("block_id = 0").first()
    assert row["begin"] == [10, 20] and row["end"] == [12, 24]
    assert spark.range(1).select(s.block_of([F.lit(19), F.lit(30)])).first()[0] == 8
    o = Blocking((0, 0), (10, 10), (5, 5))
    got = o.local_overlaps(spark, (1, 1), spark.createDataFrame([(0, 1)], "a long, b long")).first()
    assert [got["begin_a"], got["end_a"], got["begin_b"], got["end_b"]] == [[0, 4], [6, 6], [0, 0], [6, 2]]
    assert o.local_overlaps(spark, (0, 0), spark.createDataFrame([(0, 3)], "a long, b long")).count() == 0


def test_traversal(spark):
    edges = edge_table(spark, [(0, 0, 1), (1, 2, 3), (2, 1, 4)], "edge_id long, u long, v long")
    assert labels_of(graphs.connected_components(node_table(spark, 5), edges)) == [0, 0, 1, 1, 0]
    chain = edge_table(spark, [(k, k, k + 1) for k in range(5)], "edge_id long, u long, v long")
    assert table(graphs.breadth_first_search(chain, 0, 3), "node", "distance") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    names = node_table(spark, 6).withColumn("label", F.col("node") % 2)
    hop = lambda *a: table(graphs.lifted_edges_from_node_labels(chain, names, *a), "u", "v")
    assert hop(2) == [(0, 2), (1, 3), (2, 4), (3, 5)]
    assert hop(3, "different") == [(0, 3), (1, 4), (2, 5)] and hop(3, "same") == [(0, 2), (1, 3), (2, 4), (3, 5)]


def test_embedding_and_affinity(spark):
    px, shape = image(spark, [[1, 1, 2]])
    got = affinities.compute_affinities(px, [(0, 1), (0, -1)], shape, ignore_label=2)
    assert table(got, "channel", "node_id", "affinity", "mask") == [(0, 0, 1, 1), (0, 1, 0, 0), (0, 2, 0, 0), (1, 0, 0, 0), (1, 1, 1, 1), (1, 2, 0, 0)]


def random_graph(spark, seed, n=14, p=0.35):
    rng = np.random.default_rng(seed)
    pairs = [e for e in itertools.combinations(range(n), 2) if rng.random() < p]
    return n, [(k, u, v, float(rng.normal())) for k, (u, v) in enumerate(pairs)]


def arrays(rows):
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_divided_is_undivided(spark, seed):
    n, rows = random_graph(spark, seed)
    u, v, cost = arrays(rows)
    nodes, edges = node_table(spark, n), edge_table(spark, rows)
    assert same_partition(labels_of(partition.greedy_additive_multicut(nodes, edges)), kernels.greedy_additive(n, u, v, cost).tolist())
    assert same_partition(labels_of(partition.greedy_fixation_multicut(nodes, edges)), kernels.greedy_fixation(n, u, v, cost).tolist())
    sized = edges.withColumn("size", F.lit(1.0))
    for linkage in ("sum", "mean", "mutex_watershed"):
        got = labels_of(partition.gasp(nodes, sized, linkage))
        assert same_partition(got, kernels.gasp(n, u, v, cost, linkage=linkage).tolist())
    mutex = edges.select("edge_id", "u", "v", F.abs("cost").alias("cost"), (F.col("cost") < 0).alias("is_mutex"))
    assert same_partition(labels_of(partition.mutex_watershed_clustering(nodes, mutex)), kernels.mutex_watershed(n, u, v, np.abs(cost), cost < 0).tolist())


def naive_greedy(n, u, v, cost):
    label = list(range(n))
    while True:
        between = {}
        for a, b, x in zip(u, v, cost, strict=True):
            if label[a] != label[b]:
                key = (min(label[a], label[b]), max(label[a], label[b]))
                between[key] = between.get(key, 0) + x
        key = max(between, key=between.get, default=None)
        if key is None or between[key] <= 0:
            return label
        label = [key[0] if c == key[1] else c for c in label]


def test_kernels_against_naive():
    for seed in range(40):
        n, rows = random_graph(None, seed, 9)
        if not rows:
            continue
        u, v, cost = arrays(rows)
        first = kernels.greedy_additive(n, u, v, cost)
        assert same_partition(first.tolist(), naive_greedy(n, u, v, cost))
        e = kernels.energy(u, v, cost, first)
        better = kernels.kernighan_lin(n, u, v, cost)
        assert kernels.energy(u, v, cost, better) <= e + 1e-9
        assert kernels.energy(u, v, cost, kernels.fusion_move(n, u, v, cost)) <= e + 1e-9
    chain = np.array([0, 1, 2]), np.array([1, 2, 3])
    assert same_partition(kernels.greedy_additive(4, *chain, np.array([1.0, 2, -5])).tolist(), [0, 0, 0, 1])
    assert same_partition(kernels.greedy_additive(4, *chain, np.array([1.0, 2, -5]), 1.5).tolist(), [0, 1, 1, 2])
    u, v = np.array([0, 1, 0]), np.array([1, 2, 2])
    assert same_partition(kernels.mutex_watershed(3, u, v, np.array([1.0, 1, 2]), np.array([0, 0, 1])).tolist(), [0, 0, 1])
    u, v = np.array([0, 1, 2, 0]), np.array([1, 2, 3, 3])
    assert same_partition(kernels.mutex_watershed(4, u, v, np.array([10.0, 9, 4, 5]), np.array([0, 0, 0, 1])).tolist(), [0, 0, 0, 1])
    got = kernels.edge_weighted_watershed(5, np.arange(4), np.arange(1, 5), np.array([0.1, 0.5, 0.2, 0.1]), np.array([1, 0, 0, 0, 2]))
    assert got.tolist() == [1, 1, 2, 2, 2]


def test_grid_mutex_watershed(spark):
    px, shape = image(spark, [[0, 0]])
    affs = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0), (1, 0, 0.9), (1, 1, 0.0)], "channel int, node_id long, affinity double")
    got = partition.mutex_watershed(px, affs, [(0, 1), (0, 1)], 1, shape)
    assert table(got, "node_id", "label") == [(0, 1), (1, 2)]


def test_label_components(spark):
    a = np.array([[1, 0, 1], [1, 0, 0], [0, 1, 2]])
    px, shape = image(spark, a)
    assert [r["component"] for r in partition.label_components(px, shape).orderBy("node_id").collect()] == [1, 0, 2, 1, 0, 0, 0, 1, 3]
    assert [r["component"] for r in partition.label_components(px, shape, connectivity=1).orderBy("node_id").collect()] == [1, 0, 2, 1, 0, 0, 0, 3, 4]


def test_watershed(spark):
    px, shape = image(spark, np.zeros((1, 7), int), value=[[0.0, 1, 2, 9, 2, 1, 0]], seed=[[1, 0, 0, 0, 0, 0, 2]])
    assert [r["label"] for r in partition.watershed(px, shape).orderBy("node_id").collect()][:3] == [1, 1, 1]
    assert [r["label"] for r in partition.watershed(px, shape).orderBy("node_id").collect()][4:] == [2, 2, 2]


def test_distances(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((4, 5, 6)) > 0.2).astype(int)
    px, shape = image(spark, a)
    got = fields.distance_transform(px.withColumn("value", F.col("label")), shape, (2.0, 1.0, 0.5)).orderBy("node_id").collect()
    zero = np.argwhere(a == 0) * [2, 1, 0.5]
    for r, p in zip(got, np.ndindex(a.shape), strict=True):
        assert abs(r["distance"] - np.sqrt((((np.array(p) * [2, 1, 0.5]) - zero) ** 2).sum(axis=1).min())) < 1e-5
    none, shape = image(spark, np.ones((3, 2), int))
    got = fields.distance_transform(none.withColumn("value", F.col("label")), shape).orderBy("node_id").collect()
    assert [r["distance"] for r in got] == [1, 1, 2, 2, 3, 3]


def test_paths(spark):
    px, shape = image(spark, np.ones((5, 5), int))
    own = px.where("NOT (y = 2 AND x < 4)").withColumn("source", F.col("node_id") == 0).withColumn("cost", F.lit(1.0)).withColumn("speed", F.lit(1.0))
    got = {r["node_id"]: r["distance"] for r in fields.dijkstra_distance_field(own, shape).collect()}
    assert got[4] == 4 and got[14] == 6 and got[15] == 11
    field = {r["node_id"]: r["distance"] for r in fields.geodesic_distance_field(own, shape).collect()}
    assert field[4] == 4 and field[1] == 1 and abs(field[6] - (1 + 2**-0.5)) < 1e-12
    before = {r["node_id"]: r["predecessor"] for r in fields.dijkstra_distance_field(own, shape, predecessors=True).collect()}
    assert before[0] == 0 and before[14] == 9


def test_suppression(spark):
    pts = [(0, 0, 5, 5, 5.0), (1, 0, 5, 6, 4.0), (2, 0, 90, 90, 0.0)]
    got = fields.non_maximum_suppression(spark.createDataFrame(pts, "point_id long, z int, y int, x int, radius double"))
    assert table(got, "point_id") == [(0,), (2,)]


def test_filters_and_warp(spark):
    rng = np.random.default_rng(5)
    a = rng.random((6, 7))
    px, shape = image(spark, np.zeros((6, 7), int), value=a)
    k = np.array(filters.kernel(1.5))
    assert abs(k.sum() - 1) < 1e-6
    pad = np.pad(a, len(k) // 2, mode="reflect")
    want = np.array([[(pad[y : y + len(k), x : x + len(k)] * np.outer(k, k)).sum() for x in range(7)] for y in range(6)])
    got = np.array([r["value"] for r in filters.gaussian_smoothing(px, shape, 1.5).orderBy("node_id").collect()]).reshape(6, 7)
    assert np.abs(got - want).max() < 1e-9
    ramp = filters.kernel(1.0, 1)
    assert abs(sum(-i * w for i, w in zip(range(-len(ramp) // 2 + 1, len(ramp) // 2 + 1), ramp, strict=True)) - 1) < 1e-6
    at = px.select(F.col("node_id").alias("target"), "z", "y", "x")
    for order in range(6):
        same = warp.affine_transform(px, at, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], shape, order).orderBy("target").collect()
        if order in (0, 1, 3):
            assert np.abs(np.array([r["value"] for r in same]) - a.ravel()).max() < 1e-12
    assert warp.anti_aliasing_sigma([(3.0, 0.0, 0.0), (0.0, 0.5, 0.0)]) == [1.0, 0.0]
    m = rng.random((3, 3))
    m = m + m.T
    row = spark.createDataFrame([tuple(float(m[i, j]) for i in range(3) for j in range(i, 3))], "a double, b double, c double, d double, e double, f double")
    ev = filters.eigenvalues({p: F.col(c) for p, c in zip([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], "abcdef", strict=True)}, 3)
    assert np.allclose(list(row.select(*ev).first()), np.sort(np.linalg.eigvalsh(m))[::-1])


def test_meshes(spark):
    verts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vertex_id long, z double, y double, x double")
    faces = spark.createDataFrame([(0, 1, 2)], "a long, b long, c long")
    got = meshes.smooth_mesh(verts, faces, 2).orderBy("vertex_id").collect()
    assert all(abs(r["z"] - 1 / 3) < 1e-12 for r in got)
    sk = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 0, 1, 2.0), (1, 0, 0, 0, 3.0)], "label long, z long, y long, x long, radius double")
    ed = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 1), (1, 0, 0, 1, 0, 0, 0)], "label long, z0 long, y0 long, x0 long, z1 long, y1 long, x1 long")
    v, e = meshes.merge_skeletons(sk, ed)
    assert table(v, "vertex_id", "radius") == [(0, 3.0), (1, 2.0)] and table(e, "u", "v") == [(0, 1)]


def test_undivided_solve(spark):
    n, rows = random_graph(spark, 7)
    got = solve(node_table(spark, n), edge_table(spark, rows), kernels.greedy_additive, whole=True)
    assert same_partition(labels_of(got), kernels.greedy_additive(n, *arrays(rows)).tolist())


def closed(faces):
    """Every directed side of a closed, consistently turned surface has its opposite."""
    sides = [(f[k], f[(k + 1) % 3]) for f in faces for k in range(3)]
    return len(set(sides)) == len(sides) and all((b, a) in set(sides) for a, b in sides)


def test_triangle_lists():
    lists = surfaces.triangles()
    assert len(lists) == 256 and not lists[0] and not lists[255] and all(len(lists[1 << c]) == 1 for c in range(8))
    for case in range(256):
        crossed = {e for e in range(12) for _, a, b in [surfaces.edge_ends(e)] if (case >> a & 1) != (case >> b & 1)}
        assert {e for t in lists[case] for e in t} == crossed


def test_marching_cubes(spark):
    z, y, x = np.mgrid[-6:7, -6:7, -6:7]
    ball = 5.0 - np.sqrt(z**2 + y**2 + x**2)
    px, shape = image(spark, np.zeros(ball.shape, int), value=ball)
    vertices, faces = surfaces.marching_cubes(px, shape, 0.7)
    v = {r["vertex_id"]: np.array([r["z"], r["y"], r["x"]]) - 6 for r in vertices.collect()}
    f = [tuple(r) for r in faces.collect()]
    assert closed(f) and len(v) - 3 * len(f) // 2 + len(f) == 2
    assert all(abs(np.linalg.norm(p) - 4.3) < 0.1 for p in v.values())
    volume = sum(np.dot(v[a], np.cross(v[b], v[c])) for a, b, c in f) / 6
    assert abs(abs(volume) - 4 / 3 * np.pi * 4.3**3) < 15 and volume > 0
    noise = np.zeros((7, 7, 7))
    noise[1:-1, 1:-1, 1:-1] = np.random.default_rng(2).random((5, 5, 5))
    px, shape = image(spark, np.zeros(noise.shape, int), value=noise)
    assert closed([tuple(r) for r in surfaces.marching_cubes(px, shape, 0.5)[1].collect()])
    with pytest.raises(RuntimeError):
        surfaces.marching_cubes(px, shape, 9.0)


def test_teasar(spark):
    a = np.zeros((5, 5, 24), int)
    a[1:4, 1:4, 1:23] = 1
    a[0, 0, 0] = 2
    px, shape = image(spark, a)
    got = skeletons.teasar_labels(px, shape)
    rows = got.where("label = 1").collect()
    inside = {tuple(p) for p in np.argwhere(a == 1)}
    assert {(r["z"], r["y"], r["x"]) for r in rows} <= inside and len({(r["z"], r["y"], r["x"]) for r in rows}) == len(rows)
    assert sum(r["parent"] < 0 for r in rows) == 1 and max(r["radius"] for r in rows) == 2
    assert {r["x"] for r in rows} >= set(range(1, 23))
    assert got.where("label = 2").count() == 1
    assert skeletons.forest_edges(got).count() == got.count() - 2


def test_flow_density(spark):
    y, x = np.mgrid[0:7, 0:9]
    px, shape = image(spark, np.ones((7, 9), int), fg=np.ones((7, 9), bool), fz=np.zeros((7, 9)), fy=(3.0 - y), fx=(4.0 - x))
    got = np.array([r["density"] for r in flow.flow_density(px, shape, steps=80).orderBy("node_id").collect()]).reshape(7, 9)
    assert got[3, 4] == 63 and got.sum() == 63
    px, shape = image(spark, np.ones((2, 9), int), fg=np.arange(18).reshape(2, 9) % 9 != 4, fz=np.zeros((2, 9)), fy=np.zeros((2, 9)), fx=np.ones((2, 9)))
    got = np.array([r["density"] for r in flow.flow_density(px, shape, steps=80, method="euler").orderBy("node_id").collect()]).reshape(2, 9)
    assert got[:, 3].tolist() == [4, 4] and got[:, 8].tolist() == [4, 4] and got.sum() == 16


def test_median_agglomeration_and_affinity_watershed(spark):
    space = kernels.Histogram(40, 0.0, 1.0)
    assert abs(space.of(0.3).sum() - 1) < 1e-12 and 0.2 < space.median(space.of(0.3) + space.of(0.3)) < 0.4
    u, v = np.array([0, 1, 2, 0]), np.array([1, 2, 3, 2])
    assert same_partition(kernels.median_agglomeration(4, u, v, np.array([0.1, 0.2, 0.9, 0.3])).tolist(), [0, 0, 0, 1])
    px, shape = image(spark, np.zeros((1, 6), int), seed=[[1, 0, 0, 0, 0, 2]])
    affs = spark.createDataFrame([(0, k, a) for k, a in enumerate([0.9, 0.8, 0.1, 0.7, 0.9, 0.0])], "channel int, node_id long, affinity double")
    got = partition.watershed_from_affinities(px, affs, [(0, 1)], shape).orderBy("node_id").collect()
    assert [r["label"] for r in got] == [1, 1, 1, 2, 2, 2]


def test_lifted_search_and_chain(spark):
    for seed in range(20):
        n, rows = random_graph(None, seed, 9, 0.5)
        u, v, cost = arrays(rows)
        lifted = np.arange(len(u)) % 3 == 0
        first = kernels.lifted_greedy_additive(n, u, v, cost, lifted)
        last = kernels.lifted_kernighan_lin(n, u, v, cost, lifted)
        assert kernels.energy(u, v, cost, last) <= kernels.energy(u, v, cost, first) + 1e-9
        assert same_partition(last.tolist(), kernels.split_unconnected(n, u[~lifted], v[~lifted], last).tolist())
    n, rows = random_graph(spark, 3)
    u, v, cost = arrays(rows)
    got = np.array(labels_of(partition.chained_multicut(node_table(spark, n), edge_table(spark, rows), [kernels.greedy_fixation, kernels.kernighan_lin])))
    assert kernels.energy(u, v, cost, got) <= kernels.energy(u, v, cost, kernels.greedy_fixation(n, u, v, cost)) + 1e-9


def test_path_and_gradient(spark):
    px, shape = image(spark, np.ones((3, 4), int))
    own = px.withColumn("source", F.col("node_id") == 0).withColumn("cost", F.lit(1.0)).withColumn("speed", F.lit(1.0))
    assert [r["node_id"] for r in fields.dijkstra_path(own, shape, 3).orderBy("step").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="no path"):
        fields.dijkstra_path(own.where("x != 1"), shape, 3).collect()
    line = own.where("y = 0")
    got = fields.geodesic_gradient(fields.geodesic_distance_field(line, shape), line, shape).orderBy("node_id").collect()
    assert [r["gx"] for r in got] == [0, 1, 1, 1] and all(r["gy"] == 0 for r in got)


def test_remove_ticks(spark):
    # a line of ten with a tick of one at 3, a branch of three at 6
    points = [(k, 0, 0, k) for k in range(10)] + [(10, 0, 1, 3)] + [(11 + k, 0, 1 + k, 6) for k in range(3)]
    pairs = [(k, k + 1) for k in range(9)] + [(3, 10), (6, 11), (11, 12), (12, 13)]
    v = spark.createDataFrame(points, "vertex_id long, z long, y long, x long")
    e = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "edge_id long, u long, v long")
    assert sorted(set(range(len(pairs))) - {r["edge_id"] for r in meshes.remove_ticks(v, e, 2.0).collect()}) == [9]
    left = {r["edge_id"] for r in meshes.remove_ticks(v, e, 3.5).collect()}
    assert left == set(range(12 + 1)) - {9, 10, 11, 12} or left == set(range(13)) - {9, 6, 7, 8}
    assert meshes.minimum_spanning_forest(v, e).count() == len(pairs)


def test_components_of_edges_in_one_task_or_many(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 330)]
    up = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in up:
        for a, b in pairs:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    edges = spark.createDataFrame(pairs, "u long, v long")
    want = sorted(up.items())
    assert table(graphs.roots(edges), "node", "root") == want
    assert graphs.roots(edges.limit(0)).count() == 0
    # Stars of a few nodes, of several tasks, leave the rest to the rounds.
    small = [pd.concat(list(graphs._forest([pd.DataFrame(pairs[k : k + 7], columns=["u", "v"])], 4))) for k in range(0, len(pairs), 7)]
    with_coalescing = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert table(graphs.roots(spark.createDataFrame(pd.concat(small))), "node", "root") == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_coalescing)


def test_lifted_search_goes_on_until_nothing_improves():
    """Thirty copies of a graph side by side end as low as thirty times one: no round counts for one copy alone."""
    rng = np.random.default_rng(193)
    n, copies = 7, 30
    u, v = map(np.array, zip(*[(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6], strict=True))
    cost = rng.normal(0, 1, len(u)).round(2)
    lifted = rng.random(len(u)) < 0.3
    one = kernels.energy(u, v, cost, kernels.lifted_kernighan_lin(n, u, v, cost, lifted))
    us, vs = (np.concatenate([x + n * c for c in range(copies)]) for x in (u, v))
    all_costs = np.tile(cost, copies)
    label = kernels.lifted_kernighan_lin(n * copies, us, vs, all_costs, np.tile(lifted, copies))
    assert abs(kernels.energy(us, vs, all_costs, label) - copies * one) < 1e-6


def line(points, first=0):
    """Vertices (vertex_id, z, y, x) and edges of a polyline."""
    return [(first + k, 0.0, float(y), float(x)) for k, (y, x) in enumerate(points)], [(first + k, first + k + 1) for k in range(len(points) - 1)]


def skeleton(spark, *lines):
    rows, pairs = [], []
    for points in lines:
        v, e = line(points, len(rows))
        rows += v
        pairs += e
    vertices = spark.createDataFrame(rows, "vertex_id long, z double, y double, x double")
    return vertices, spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "edge_id long, u long, v long")


def test_ends_join_across_straight_gaps_alone(spark):
    # 0-3 and 4-7 go on along one line; 8-10 starts as near, but at a right angle; 11-12 is too far away.
    v, e = skeleton(spark, [(0, x) for x in range(4)], [(0, x) for x in range(5, 9)], [(y, 3) for y in range(2, 5)], [(0, 20), (0, 21)])
    after = table(filaments.join_close_components(v, e, 2.5), "edge_id", "u", "v")
    assert after == table(e, "edge_id", "u", "v") + [(9, 3, 4)]
    assert table(filaments.join_close_components(v, e.limit(0), 2.5), "u") == []


def test_junctions_split_by_angle(spark):
    # A line with a side arm at its middle (vertex 2), and a crossing at vertex 6 of two lines.
    v = spark.createDataFrame(
        [(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 2), (3, 0, 0, 3), (4, 0, 1, 2), (5, 0, 2, 2), (6, 0, 9, 9), (7, 0, 9, 8), (8, 0, 9, 10), (9, 0, 8, 9), (10, 0, 10, 9)],
        "vertex_id long, z long, y long, x long",
    )
    pairs = [(0, 1), (1, 2), (2, 3), (2, 4), (4, 5), (6, 7), (6, 8), (6, 9), (6, 10)]
    e = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "edge_id long, u long, v long")
    v2, e2 = filaments.split_junctions(v, e)
    assert table(e2, "edge_id", "u", "v") == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (4, 4, 5), (5, 6, 7), (6, 6, 8), (7, 11, 9), (8, 11, 10)]
    assert v2.count() == 12 and tuple(v2.where("vertex_id = 11").first()) == (11, 0, 9, 9)
    cleaned = filaments.clean_filament_graph(v, e, join_dist=0.5)
    assert cleaned[1].count() == 8 and cleaned[0].count() == 12
    # Arms too close to both others stay.
    assert filaments.split_junctions(v, e, min_branch_angle=95.0)[1].where("edge_id = 3").count() == 1


def test_tubes(spark):
    v = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 4, 2), (2, 0, 0, 2)], "vertex_id long, z long, y long, x long")
    e = spark.createDataFrame([(0, 0, 1), (1, 2, 1)], "edge_id long, u long, v long")
    labels = spark.createDataFrame([(0, 5), (1, 5), (2, 8)], "node long, label long")
    got = dict(table(filaments.draw_tubes(v, e, labels, (1, 5, 3), 0), "node_id", "label"))
    want = {}
    for start, label in (((0, 0), 6), ((0, 2), 9)):
        for t in np.linspace(0, 1, 5):
            y, x = np.rint(np.array(start) + t * (np.array([4, 2]) - start)).astype(int)
            want[int(y * 3 + x)] = label
    assert got == want


def test_front_on_a_mesh(spark):
    """On an equilateral triangle a front from one corner, and a planar one, arrive as geometry says."""
    h = 3**0.5 / 2
    c, a, b = np.array([0, h, 0.5]), np.array([0, 0, 0.0]), np.array([0, 0, 1.0])
    assert abs(meshfields.arrival(c, a, b, 0.0, 0.0, 2.0) - 2 * h) < 1e-12  # from the side between them
    assert abs(meshfields.arrival(c, a, b, 0.0, 5.0, 1.0) - 1.0) < 1e-12  # along the edge
    rows = [(0, 0, 0, 0, True, 1.0), (1, 0, 0, 1, False, 1.0), (2, 0, 1, 0, False, 1.0), (3, 0, 1, 1, False, 0.0), (4, 9, 9, 9, False, 1.0)]
    v = spark.createDataFrame([(i, float(z), float(y), float(x), s, f) for i, z, y, x, s, f in rows], "vertex_id long, z double, y double, x double, source boolean, speed double")
    f = spark.createDataFrame([(0, 1, 2), (1, 3, 2)], "a long, b long, c long")
    got = dict(table(meshfields.geodesic_distance_field_mesh(v, f), "vertex_id", "distance"))
    assert got[0] == 0 and got[1] == got[2] == 1 and got[3] == got[4] == float("inf")
    points = spark.createDataFrame([(0,), (2,), (4,)], "vertex_id long")
    m = {(x, y): t for x, y, t in table(meshfields.geodesic_distances_mesh(v, f, points), "a", "b", "distance")}
    assert m[0, 2] == m[2, 0] == 1 and m[0, 4] == float("inf") and m[4, 4] == 0


def test_pairs_that_are_there_twice_are_an_error(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 1), (1, 0, 0, 1, 2)], "node_id long, z int, y int, x int, label long")
    affs = spark.createDataFrame([(0, 0, 0.5)], "channel int, node_id long, affinity double")
    one = spark.createDataFrame([(1, 2)], "u long, v long")
    assert rag.lifted_affinity_features(one, px, affs, [(0, 1)], (1, 1, 2)).count() == 1
    with pytest.raises(Exception, match="a pair twice"):
        rag.lifted_affinity_features(one.unionByName(one.selectExpr("v AS u", "u AS v")), px, affs, [(0, 1)], (1, 1, 2)).collect()


def test_local_and_lifted_affinities_together(spark):
    rng = np.random.default_rng(4)
    offsets, shape = [(0, 1), (2, 2), (1, 0)], (1, 6, 7)
    affs = spark.createDataFrame([(c, n, float(rng.random())) for c in range(3) for n in range(42)], "channel int, node_id long, affinity double")
    local, lifted = gridgraph.grid_affinity_features_with_lifted(spark, affs, offsets, shape)
    alone = gridgraph.grid_affinity_features(spark, affs.where("channel != 1").withColumn("channel", F.expr("int(channel / 2)")), [offsets[0], offsets[2]], shape)
    assert table(local, "edge_id", "weight", "valid") == table(alone, "edge_id", "weight", "valid")
    assert table(lifted, "node_id", "weight") == table(gridgraph.grid_lifted_edges(affs, offsets, shape), "node_id", "weight") and lifted.count() == 20
    with pytest.raises(ValueError, match="no steps"):
        gridgraph.grid_affinity_features_with_lifted(spark, affs, [(0, 0)], shape)


def test_lifted_objective_within_hops(spark):
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 2.0), (2, 2, 3, 3.0)], "edge_id long, u long, v long, cost double")
    more = spark.createDataFrame([(0, 0, 2, -4.0)], "pos long, u long, v long, cost double")
    got = table(graphs.lifted_objective(edges, more, bfs_distance=2), "u", "v", "cost", "is_lifted")
    assert got == [(0, 1, 1.0, False), (0, 2, -4.0, True), (1, 2, 2.0, False), (1, 3, 0.0, True), (2, 3, 3.0, False)]


def test_fusion_with_several_proposals_and_other_solvers():
    rng = np.random.default_rng(11)
    n = 24
    u, v = map(np.array, zip(*[(a, b) for a in range(n) for b in range(a) if rng.random() < 0.3]))
    cost = rng.normal(0, 1, len(u))
    greedy = kernels.energy(u, v, cost, kernels.greedy_additive(n, u, v, cost))
    for propose in (None, kernels.watershed_proposal):
        for proposals in (1, 3):
            best = kernels.fusion_move(n, u, v, cost, propose=propose, proposals=proposals, solver=kernels.greedy_fixation, start=kernels.greedy_additive(n, u, v, cost))
            assert kernels.energy(u, v, cost, best) <= greedy + 1e-9
    assert len(set(kernels.watershed_proposal(rng, n, u, v, np.abs(cost)).tolist())) == 1
    lifted = rng.random(len(u)) < 0.4
    start = kernels.lifted_greedy_additive(n, u, v, cost, lifted)
    for propose in (None, kernels.watershed_proposal):
        best = kernels.lifted_fusion_move(n, u, v, cost, lifted, propose=propose)
        assert kernels.energy(u, v, cost, best) <= kernels.energy(u, v, cost, start) + 1e-9
        assert len(set(kernels.split_unconnected(n, u[~lifted], v[~lifted], best).tolist())) == len(set(best.tolist()))
