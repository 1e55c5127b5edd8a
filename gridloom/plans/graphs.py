"""Queries of the graph, field, filter, warp, mesh and partition operators; SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.operators import fields, filters, flow, graphs, kernels, meshes, partition, rag, skeletons, surfaces, warp
from gridloom.plans.relational import CT, ED, OFFSETS, PX, grid, other_affinities, rounded, w
from gridloom.sources import tables as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# The region graph of the event grid, with costs from the mean value along each edge.

GR = """gr AS (SELECT edge_id, ed.u, ed.v, 50 - m AS cost FROM ed JOIN (
  SELECT u, v, avg(0.5 * (va + vb)) AS m FROM ct GROUP BY u, v) f ON ed.u = f.u AND ed.v = f.v)"""
#: Reachability along the edges of positive cost.
RC = """nd AS (SELECT DISTINCT label AS node FROM px), bw AS (SELECT u AS a, v AS b FROM gr WHERE cost > 4 UNION ALL SELECT v, u FROM gr WHERE cost > 4),
rc(node, r) AS (SELECT node, node FROM nd UNION SELECT rc.node, bw.b FROM rc JOIN bw ON rc.r = bw.a),
root AS (SELECT node, min(r) AS root FROM rc GROUP BY node)"""


def region_graph(spark, d):
    px, shape = grid(spark, d)
    edges = rag.region_adjacency_graph(px, shape)
    means = rag.edge_map_features(px, shape)
    nodes = px.select(F.col("label").alias("node")).distinct()
    return nodes, edges.join(means, ["u", "v"]).select("edge_id", "u", "v", (50 - F.col("mean")).alias("cost"), F.col("size").cast("double").alias("size"))


def rec(*parts):
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


@query("connected_components", rec(PX, CT, ED, GR, RC) + "SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS label FROM root")
def connected_components(spark, d):
    nodes, edges = region_graph(spark, d)
    return graphs.connected_components(nodes, edges.where("cost > 4"))


@query("label_components", rec(PX, """nb AS (SELECT a.node_id AS a, b.node_id AS b FROM px a, (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)) o(dy, dx), px b
  WHERE b.y = a.y + dy AND b.x = a.x + dx AND a.other = b.other AND a.other <> 0),
rc(node, r) AS (SELECT node_id, node_id FROM px WHERE other <> 0 UNION SELECT rc.node, nb.b FROM rc JOIN nb ON rc.r = nb.a),
root AS (SELECT node, min(r) AS root FROM rc GROUP BY node)""") + """SELECT px.node_id, coalesce(k, 0) AS component FROM px LEFT JOIN (
  SELECT node, dense_rank() OVER (ORDER BY root) AS k FROM root) c ON c.node = px.node_id""")
def label_components(spark, d):
    px, shape = grid(spark, d)
    return partition.label_components(px, shape, connectivity=1, value="other")


@query("bfs_k", rec(PX, CT, ED, """bw AS (SELECT u AS a, v AS b FROM ed UNION ALL SELECT v, u FROM ed),
hop(node, n) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT bw.b, n + 1 FROM hop JOIN bw ON hop.node = bw.a WHERE n < 5)""") + """
SELECT node, CAST(min(n) AS BIGINT) AS distance FROM hop GROUP BY node""")
def bfs_k(spark, d):
    return graphs.breadth_first_search(rag.region_adjacency_graph(*grid(spark, d)), 7, 5)


HOPS = """bw AS (SELECT u AS a, v AS b FROM ed UNION ALL SELECT v, u FROM ed),
hop(s, node, n) AS (SELECT a, b, 1 FROM bw UNION SELECT s, bw.b, n + 1 FROM hop JOIN bw ON hop.node = bw.a WHERE n < 3),
far AS (SELECT s AS u, node AS v, CAST(min(n) AS BIGINT) AS distance FROM hop WHERE s < node GROUP BY ALL HAVING min(n) >= 2)"""


@query("lifted_from_node_labels", rec(PX, CT, ED, HOPS) + "SELECT u, v, distance FROM far WHERE u % 3 = v % 3 AND u % 3 <> 1")
def lifted_from_node_labels(spark, d):
    px, shape = grid(spark, d)
    labels = px.select(F.col("label").alias("node"), (F.col("label") % 3).alias("label")).distinct()
    return graphs.lifted_edges_from_node_labels(rag.region_adjacency_graph(px, shape), labels, 3, "same", 1)


@query("multicut_energy", w(PX, CT, ED, GR) + "SELECT round(sum(CASE WHEN u % 17 <> v % 17 THEN cost ELSE 0 END), 4) + 0.0 AS energy FROM gr")
def multicut_energy(spark, d):
    nodes, edges = region_graph(spark, d)
    return rounded(graphs.multicut_energy(edges, nodes.withColumn("label", F.col("node") % 17)), "energy", digits=4)


@query("contracted_graph", w(PX, CT, ED, GR) + """SELECT least(u % 17, v % 17) AS u, greatest(u % 17, v % 17) AS v, round(sum(cost), 4) + 0.0 AS cost
FROM gr WHERE u % 17 <> v % 17 GROUP BY 1, 2""")
def contracted_graph(spark, d):
    nodes, edges = region_graph(spark, d)
    return rounded(graphs.contract(edges, nodes.withColumn("label", F.col("node") % 17)), "cost", digits=4)


PAIRS = "pr AS (SELECT event_id AS pos, user_id AS u, event_id % 53 AS v FROM events WHERE user_id <> event_id % 53)"
FE = """fe AS (SELECT row_number() OVER (ORDER BY f) - 1 AS edge_id, u, v FROM (
  SELECT least(u, v) AS u, greatest(u, v) AS v, min(pos) AS f FROM pr GROUP BY 1, 2))"""


def user_pairs(spark, d):
    return t.read(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("u"), (F.col("event_id") % 53).alias("v")).where("u != v")


@query("graph_from_edges", w(PAIRS, FE) + "SELECT edge_id, u, v FROM fe")
def graph_from_edges(spark, d):
    return graphs.from_edges(user_pairs(spark, d))


@query("find_edges", w(PAIRS, FE, "q AS (SELECT event_id AS id, event_id % 61 AS u, user_id AS v FROM events)") + """
SELECT id, q.u, q.v, coalesce(edge_id, -1) AS edge_id FROM q LEFT JOIN fe ON fe.u = least(q.u, q.v) AND fe.v = greatest(q.u, q.v)""")
def find_edges(spark, d):
    asked = t.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 61).alias("u"), F.col("user_id").alias("v"))
    return graphs.find_edges(graphs.from_edges(user_pairs(spark, d)), asked)


@query("node_adjacency", w(PAIRS, FE) + "SELECT CASE WHEN u = 5 THEN v ELSE u END AS neighbor, edge_id FROM fe WHERE u = 5 OR v = 5")
def node_adjacency(spark, d):
    return graphs.node_adjacency(graphs.from_edges(user_pairs(spark, d)), 5)


@query("subgraph_edges", w(PAIRS, FE) + "SELECT edge_id, u < 20 AND v < 20 AS inner FROM fe WHERE u < 20 OR v < 20".replace("AS inner", 'AS "inner"'))
def subgraph_edges(spark, d):
    return graphs.subgraph_edges(graphs.from_edges(user_pairs(spark, d)), spark.range(20).withColumnRenamed("id", "node"))


@query("edges_from_node_list", w(PAIRS, FE) + "SELECT edge_id, u, v FROM fe WHERE u < 20 AND v < 20")
def edges_from_node_list(spark, d):
    return graphs.edges_from_node_list(graphs.from_edges(user_pairs(spark, d)), spark.range(20).withColumnRenamed("id", "node"))


@query("graph_round_trip", w(PAIRS, FE) + "SELECT edge_id, u, v FROM fe")
def graph_round_trip(spark, d):
    return t.unpacked_graph(t.packed_graph(graphs.from_edges(user_pairs(spark, d)), 200))


@query("lifted_objective", w(PX, CT, ED, GR) + """SELECT u, v, round(sum(cost), 6) + 0.0 AS cost, bool_and(l) AS is_lifted FROM (
  SELECT u, v, cost, false AS l FROM gr UNION ALL SELECT label, label + 1 + node_id % 3, value / 8, true FROM px WHERE label + 1 + node_id % 3 IN (SELECT label FROM px)
) GROUP BY u, v""")
def lifted_objective(spark, d):
    """Every pixel of every region votes for a lifted edge to one of the three regions after its own."""
    px, _ = grid(spark, d)
    nodes, edges = region_graph(spark, d)
    more = px.select(F.col("node_id").alias("pos"), F.col("label").alias("u"), (F.col("label") + 1 + F.col("node_id") % 3).alias("v"), (F.col("value") / 8).alias("cost"))
    more = more.join(nodes, F.col("v") == F.col("node"), "left_semi")  # the last regions have no three after them
    return rounded(graphs.lifted_objective(edges, more), "cost")


# Fields and points.


@query("edt", w(PX) + """SELECT a.node_id, round(CAST(CAST(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS FLOAT) AS DOUBLE), 4) + 0.0 AS distance
FROM px a, px b WHERE b.value < 1 GROUP BY a.node_id""")
def edt(spark, d):
    px, shape = grid(spark, d)
    marked = px.withColumn("value", F.when(F.col("value") < 1, 0).otherwise(1))
    found = fields.distance_transform(marked, shape).select("node_id", F.col("distance").cast("double").alias("distance"))
    return rounded(found, "distance", digits=4)


@query("vector_difference_transform")
def vector_difference_transform(spark, d):
    px, shape = grid(spark, d)
    return fields.vector_difference_transform(px.withColumn("value", F.when(F.col("value") < 1, 0).otherwise(1)), shape)


@query("point_nms", w(PX, "pt AS (SELECT node_id AS point_id, y, x, value / 40 AS radius FROM px)") + """
SELECT DISTINCT best AS point_id FROM (SELECT a.point_id, b.point_id AS best,
  row_number() OVER (PARTITION BY a.point_id ORDER BY b.radius DESC, b.point_id) AS r
  FROM pt a JOIN pt b ON CAST(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS FLOAT) <= CAST(a.radius AS FLOAT)) WHERE r = 1""")
def point_nms(spark, d):
    px, _ = grid(spark, d)
    points = px.select(F.col("node_id").alias("point_id"), "z", "y", "x", (F.col("value") / 40).alias("radius"))
    return fields.non_maximum_suppression(points).select("point_id")


def field_pixels(spark, d):
    px, shape = grid(spark, d)
    keep = px.where("value > 8").select("node_id", "z", "y", "x", (F.col("node_id") % 1009 == 0).alias("source"), (1 + F.col("value") / 50).alias("cost"))
    return keep.withColumn("speed", F.col("cost")), shape


@query("dijkstra_distance_field")
def dijkstra_distance_field(spark, d):
    px, shape = field_pixels(spark, d)
    return fields.dijkstra_distance_field(px, shape, 2, mode="node_physical")


@query("dijkstra_predecessors")
def dijkstra_predecessors(spark, d):
    px, shape = field_pixels(spark, d)
    return fields.dijkstra_distance_field(px, shape, 1, predecessors=True)


@query("geodesic_distance_field")
def geodesic_distance_field(spark, d):
    px, shape = field_pixels(spark, d)
    return fields.geodesic_distance_field(px, shape)


def event_volume(spark, d):
    """The events as a volume with rows of 10 and slices of 10 rows."""
    px, shape = grid(spark, d)
    n = F.col("node_id")
    cut = px.select("node_id", F.expr("int(node_id div 100)").alias("z"), F.expr("int(node_id div 10 % 10)").alias("y"), (n % 10).cast("int").alias("x"), "value")
    return cut, (shape[1], 10, 10)


# Filters and warps. Taps in SQL are a list of values; borders are mirrored.


def _taps(sigma, order=0):
    k = filters.kernel(sigma, order)
    return f"(VALUES {', '.join(f'({i - len(k) // 2}, CAST({x!r} AS DOUBLE))' for i, x in enumerate(k))})"


def _pass(source, target, axis, sigma, order):
    n = "h" if axis == "y" else "w"
    m = f"((p.{axis} - k) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2)"
    on = f"s.{axis} = CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 2 - {m} END AND s.{'x' if axis == 'y' else 'y'} = p.{'x' if axis == 'y' else 'y'}"
    return f"{target} AS (SELECT p.node_id, p.y, p.x, sum(c * s.value) AS value FROM px p CROSS JOIN hw CROSS JOIN {_taps(sigma, order)} t(k, c) JOIN {source} s ON {on} GROUP BY ALL)"


def _filtered(name, sigma, oy, ox, source="px"):
    return _pass(source, f"{name}y", "y", sigma, oy) + ",\n" + _pass(f"{name}y", name, "x", sigma, ox)


@query("gaussian_smoothing", w(PX, _filtered("g", 1.2, 0, 0)) + "SELECT node_id, round(value, 5) + 0.0 AS value FROM g")
def gaussian_smoothing(spark, d):
    px, shape = grid(spark, d)
    return rounded(filters.gaussian_smoothing(px, shape, 1.2).select("node_id", "value"), "value", digits=5)


@query("gaussian_derivative", w(PX, _filtered("g", 1.2, 1, 0)) + "SELECT node_id, round(value, 5) + 0.0 AS value FROM g")
def gaussian_derivative(spark, d):
    px, shape = grid(spark, d)
    return rounded(filters.gaussian_derivative(px, shape, 1.2, [1, 0]).select("node_id", "value"), "value", digits=5)


@query("gradient_magnitude", w(PX, _filtered("fa", 1.0, 1, 0), _filtered("fb", 1.0, 0, 1)) + """
SELECT a.node_id, round(sqrt(a.value * a.value + b.value * b.value), 5) + 0.0 AS value FROM fa a JOIN fb b ON a.node_id = b.node_id""")
def gradient_magnitude(spark, d):
    return rounded(filters.gaussian_gradient_magnitude(*grid(spark, d), 1.0), "value", digits=5)


@query("laplacian_of_gaussian", w(PX, _filtered("fa", 1.0, 2, 0), _filtered("fb", 1.0, 0, 2)) + """
SELECT a.node_id, round(a.value + b.value, 5) + 0.0 AS value FROM fa a JOIN fb b ON a.node_id = b.node_id""")
def laplacian_of_gaussian(spark, d):
    return rounded(filters.laplacian_of_gaussian(*grid(spark, d), 1.0), "value", digits=5)


EIG = """SELECT a.node_id, round((a.value + b.value) / 2 + sqrt(pow((a.value - b.value) / 2, 2) + c.value * c.value), 4) + 0.0 AS e0,
round((a.value + b.value) / 2 - sqrt(pow((a.value - b.value) / 2, 2) + c.value * c.value), 4) + 0.0 AS e1
FROM fa a JOIN fb b ON a.node_id = b.node_id JOIN fc c ON a.node_id = c.node_id"""


@query("hessian_eigenvalues", w(PX, _filtered("fa", 1.0, 2, 0), _filtered("fb", 1.0, 0, 2), _filtered("fc", 1.0, 1, 1)) + EIG)
def hessian_eigenvalues(spark, d):
    return rounded(filters.hessian_eigenvalues(*grid(spark, d), 1.0), "e0", "e1", digits=4)


ST = """yy AS (SELECT node_id, y, x, value * value AS value FROM dy), xx AS (SELECT node_id, y, x, value * value AS value FROM dx),
yx AS (SELECT dy.node_id, dy.y, dy.x, dy.value * dx.value AS value FROM dy JOIN dx ON dy.node_id = dx.node_id)"""


@query("structure_tensor_eigenvalues", w(PX, _filtered("dy", 0.8, 1, 0), _filtered("dx", 0.8, 0, 1), ST, _filtered("fa", 1.0, 0, 0, "yy"), _filtered("fb", 1.0, 0, 0, "xx"), _filtered("fc", 1.0, 0, 0, "yx")) + EIG.replace(", 4) + 0.0 AS e", ", 2) + 0.0 AS e"))
def structure_tensor_eigenvalues(spark, d):
    return rounded(filters.structure_tensor_eigenvalues(*grid(spark, d), 0.8, 1.0), "e0", "e1", digits=2)


MATRIX = [(0.8, 0.1, 3.3), (-0.2, 0.9, 20.7)]
AT = "tg AS (SELECT node_id, 3.3e0 + y * 0.8e0 + x * 0.1e0 AS cy, 20.7e0 + y * -0.2e0 + x * 0.9e0 AS cx FROM px)"


def warp_targets(px):
    return px.select(F.col("node_id").alias("target"), "z", "y", "x")


@query("affine_nearest", w(PX, AT) + """SELECT tg.node_id AS target, coalesce(value, -1.0) AS value FROM tg
LEFT JOIN px ON px.y = floor(cy + 0.5) AND px.x = floor(cx + 0.5)""")
def affine_nearest(spark, d):
    px, shape = grid(spark, d)
    return warp.affine_transform(px, warp_targets(px), MATRIX, shape, 0, -1.0)


LINEAR = """SELECT tg.node_id AS target, round(sum((1 - abs(cy - y_)) * (1 - abs(cx - x_)) * coalesce(value, -1)), 5) + 0.0 AS value
FROM (SELECT node_id, cy, cx, floor(cy) + a AS y_, floor(cx) + b AS x_ FROM tg, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)) tg
LEFT JOIN px ON px.y = y_ AND px.x = x_ GROUP BY 1"""


@query("affine_linear", w(PX, AT) + LINEAR)
def affine_linear(spark, d):
    px, shape = grid(spark, d)
    return rounded(warp.affine_transform(px, warp_targets(px), MATRIX, shape, 1, -1.0), "value", digits=5)


@query("affine_box_integers", w(PX, """tg AS (SELECT y * 115 + x AS target, 3.3e0 + (y + 2) * 0.8e0 + (x + 5) * 0.1e0 AS cy, 20.7e0 + (y + 2) * -0.2e0 + (x + 5) * 0.9e0 AS cx
  FROM hw, generate_series(0, h + 4) r(y), generate_series(0, 114) c(x))""") + """SELECT target, CAST(greatest(10, least(60, round(coalesce(value, -1)))) AS BIGINT) AS value FROM tg
LEFT JOIN px ON px.y = floor(cy + 0.5) AND px.x = floor(cx + 0.5)""")
def affine_box_integers(spark, d):
    px, shape = grid(spark, d)
    return warp.affine_box(px, [*MATRIX, (0.0, 0.0, 1.0)], shape, (slice(2, shape[1] + 7), slice(5, 120)), 0, -1.0, (10, 60))


@query("map_coordinates", w(PX, "tg AS (SELECT node_id, y + value / 100 AS cy, x - value / 90 AS cx FROM px)") + LINEAR)
def map_coordinates(spark, d):
    px, shape = grid(spark, d)
    at = px.select(F.col("node_id").alias("target"), F.lit(0.0).alias("cz"), (F.col("y") + F.col("value") / 100).alias("cy"), (F.col("x") - F.col("value") / 90).alias("cx"))
    return rounded(warp.map_coordinates(px, at, shape, 1, -1.0), "value", digits=5)


KEYS = "CASE WHEN {t} <= 1 THEN (1.5 * {t} - 2.5) * {t} * {t} + 1 WHEN {t} < 2 THEN ((-0.5 * {t} + 2.5) * {t} - 4) * {t} + 2 ELSE 0 END"


@query("affine_cubic", w(PX, AT) + f"""SELECT tg.node_id AS target, round(sum(({KEYS.format(t='abs(cy - y_)')}) * ({KEYS.format(t='abs(cx - x_)')}) * coalesce(value, 0)), 11) + 0.0 AS value
FROM (SELECT node_id, cy, cx, floor(cy) + a AS y_, floor(cx) + b AS x_ FROM tg, range(-1, 3) p(a), range(-1, 3) q(b)) tg
LEFT JOIN px ON px.y = y_ AND px.x = x_ GROUP BY 1""")
def affine_cubic(spark, d):
    px, shape = grid(spark, d)
    return rounded(warp.affine_transform(px, warp_targets(px), MATRIX, shape, 3, 0.0), "value", digits=11)


def _spline(t, n):
    return " + ".join(f"{(-1) ** k * math.comb(n + 1, k) / math.factorial(n)!r} * pow(greatest({t} + {(n + 1) / 2 - k!r}, 0), {n})" for k in range(n + 2))


def _spline_sql(order):
    base = "floor({} + 0.5)" if order % 2 == 0 else "floor({})"
    low, high = -(order // 2), order // 2 + 1 + order % 2
    return w(PX, AT) + f"""SELECT tg.node_id AS target, round(sum(({_spline('abs(cy - y_)', order)}) * ({_spline('abs(cx - x_)', order)}) * coalesce(value, 0)), 11) + 0.0 AS value
FROM (SELECT node_id, cy, cx, {base.format('cy')} + a AS y_, {base.format('cx')} + b AS x_ FROM tg, range({low}, {high}) p(a), range({low}, {high}) q(b)) tg
LEFT JOIN px ON px.y = y_ AND px.x = x_ GROUP BY 1"""


def _register_splines():
    for order in (2, 4, 5):

        def run(spark, d, order=order):
            px, shape = grid(spark, d)
            return rounded(warp.affine_transform(px, warp_targets(px), MATRIX, shape, order, 0.0), "value", digits=11)

        query(f"affine_spline_{order}", _spline_sql(order))(run)


_register_splines()


@query("resample_half", w(PX, _filtered("g", 0.5, 0, 0)) + """SELECT node_id AS target, round(value, 5) + 0.0 AS value FROM g WHERE y % 2 = 0 AND x % 2 = 0""")
def resample_half(spark, d):
    px, shape = grid(spark, d)
    own = px.where("y % 2 = 0 AND x % 2 = 0").select(F.col("node_id").alias("target"), "z", (F.col("y") / 2).alias("y"), (F.col("x") / 2).alias("x"))
    return rounded(warp.resample(px, own, [(2.0, 0.0, 0.0), (0.0, 2.0, 0.0)], shape), "value", digits=5)


# Meshes and skeletons, made of the event grid's squares and of order lines.


def grid_mesh(spark, d):
    px, shape = grid(spark, d)
    vertices = px.select(F.col("node_id").alias("vertex_id"), F.col("value").alias("z"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    corner = px.where((F.col("y") < shape[1] - 1) & (F.col("x") < shape[2] - 1))
    n, wd = F.col("node_id"), shape[2]
    return vertices, corner.select(n.alias("a"), (n + 1).alias("b"), (n + wd).alias("c")).unionByName(corner.select((n + 1).alias("a"), (n + wd).alias("b"), (n + wd + 1).alias("c")))


MESH = """fc AS (SELECT node_id AS a, node_id + 1 AS b, node_id + w AS c FROM px, hw WHERE y < h - 1 AND x < w - 1
  UNION ALL SELECT node_id + 1, node_id + w, node_id + w + 1 FROM px, hw WHERE y < h - 1 AND x < w - 1),
me AS (SELECT DISTINCT least(p, q) AS u, greatest(p, q) AS v FROM (SELECT a AS p, b AS q FROM fc UNION ALL SELECT b, c FROM fc UNION ALL SELECT a, c FROM fc)),
ln AS (SELECT u, v FROM me UNION ALL SELECT v, u FROM me UNION ALL SELECT node_id, node_id FROM px)"""


@query("mesh_edges", w(PX, MESH) + "SELECT u, v FROM me")
def mesh_edges(spark, d):
    return meshes.mesh_edges(grid_mesh(spark, d)[1])


@query("smooth_mesh", w(PX, MESH, "s1 AS (SELECT u AS node_id, avg(value) AS value FROM ln JOIN px ON v = node_id GROUP BY 1)") + """
SELECT u AS vertex_id, round(avg(value), 6) + 0.0 AS z FROM ln JOIN s1 ON v = node_id GROUP BY 1""")
def smooth_mesh(spark, d):
    return rounded(meshes.smooth_mesh(*grid_mesh(spark, d), iterations=2).select("vertex_id", "z"), "z")


SK = """sv AS (SELECT user_id % 3 AS label, event_id % 11 AS z, user_id AS y, event_id % 13 AS x, value AS radius FROM events),
mv AS (SELECT label, row_number() OVER (ORDER BY label, z, y, x) - 1 AS vertex_id, z, y, x, max(radius) AS radius FROM sv GROUP BY label, z, y, x)"""


def fragments(spark, d):
    ev = t.read(spark, d, "events")
    v = ev.select((F.col("user_id") % 3).alias("label"), (F.col("event_id") % 11).alias("z"), F.col("user_id").alias("y"), (F.col("event_id") % 13).alias("x"), F.col("value").alias("radius"))
    a = v.select("label", F.col("z").alias("z0"), F.col("y").alias("y0"), F.col("x").alias("x0"))
    return v, a.select("*", F.col("z0").alias("z1"), F.col("y0").alias("y1"), ((F.col("x0") + 1) % 13).alias("x1"))


@query("skeleton_merge_vertices", w(SK) + "SELECT * FROM mv")
def skeleton_merge_vertices(spark, d):
    return meshes.merge_skeletons(*fragments(spark, d))[0]


@query("skeleton_merge_edges", w(SK) + """SELECT DISTINCT a.label, least(a.vertex_id, b.vertex_id) AS u, greatest(a.vertex_id, b.vertex_id) AS v
FROM mv a JOIN mv b ON a.label = b.label AND a.z = b.z AND a.y = b.y AND b.x = (a.x + 1) % 13 WHERE a.vertex_id <> b.vertex_id""")
def skeleton_merge_edges(spark, d):
    return meshes.merge_skeletons(*fragments(spark, d))[1]


@query("lattice_to_physical", w(SK) + "SELECT label, vertex_id, z * 2.5e0 AS z, y * 1e0 AS y, x * 0.5e0 AS x, radius FROM mv")
def lattice_to_physical(spark, d):
    return meshes.lattice_to_physical(meshes.merge_skeletons(*fragments(spark, d))[0], (2.5, 1.0, 0.5))


#: The fragments' graph, lighter edges than an edge around its first end, and what stays unconnected by these.
FOREST = """me AS (SELECT DISTINCT least(a.vertex_id, b.vertex_id) AS u, greatest(a.vertex_id, b.vertex_id) AS v, (a.x - b.x) * (a.x - b.x) AS len
  FROM mv a JOIN mv b ON a.label = b.label AND a.z = b.z AND a.y = b.y AND b.x = (a.x + 1) % 13 WHERE a.vertex_id <> b.vertex_id),
ge AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u, v, len FROM me),
gb AS (SELECT u AS a, v AS b, len, edge_id FROM ge UNION ALL SELECT v, u, len, edge_id FROM ge),
lt(e, len, node) AS (SELECT edge_id, len, u FROM ge UNION SELECT lt.e, lt.len, gb.b FROM lt JOIN gb ON lt.node = gb.a
  WHERE gb.len < lt.len OR (gb.len = lt.len AND gb.edge_id < lt.e))"""


@query("minimum_spanning_forest", rec(SK, FOREST) + "SELECT edge_id, u, v FROM ge WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.e = ge.edge_id AND lt.node = ge.v)")
def minimum_spanning_forest(spark, d):
    vertices, edges = meshes.merge_skeletons(*fragments(spark, d))
    return meshes.minimum_spanning_forest(vertices, meshes.skeleton_to_graph(vertices, edges))


@query("draw_instances", w(PX, "b AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx))") + """
SELECT (p.y + dy) * 100 + p.x + dx AS node_id, arg_max(p.other, p.node_id) + 1 AS label FROM px p, b, hw
WHERE p.y + dy >= 0 AND p.y + dy < h AND p.x + dx >= 0 AND p.x + dx < w GROUP BY 1""")
def draw_instances(spark, d):
    px, shape = grid(spark, d)
    points = px.select(F.col("node_id").alias("order"), F.col("other").alias("label"), "z", "y", "x")
    return meshes.draw_instances(points, shape, 1)


@query("marching_cubes_vertices", w("""vx AS (SELECT event_id AS node_id, event_id // 100 AS z, event_id // 10 % 10 AS y, event_id % 10 AS x, value FROM events),
cr AS (SELECT a.node_id * 3 + axis AS key, a.z + CASE WHEN axis = 0 THEN t ELSE 0 END AS z, a.y + CASE WHEN axis = 1 THEN t ELSE 0 END AS y, a.x + CASE WHEN axis = 2 THEN t ELSE 0 END AS x
  FROM (SELECT a.*, axis, (60.0::DOUBLE - a.value) / (b.value - a.value) AS t FROM vx a, (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) o(axis, dz, dy, dx), vx b
    WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND (a.value > 60) <> (b.value > 60)) a)""") + """
SELECT row_number() OVER (ORDER BY key) - 1 AS vertex_id, round(z, 9) + 0.0 AS z, round(y, 9) + 0.0 AS y, round(x, 9) + 0.0 AS x FROM cr""")
def marching_cubes_vertices(spark, d):
    return rounded(surfaces.marching_cubes(*event_volume(spark, d), 60.0)[0], "z", "y", "x", digits=9)


@query("marching_cubes_faces")
def marching_cubes_faces(spark, d):
    return surfaces.marching_cubes(*event_volume(spark, d), 60.0)[1]


@query("teasar_labels")
def teasar_labels(spark, d):
    px, shape = grid(spark, d)
    return skeletons.teasar_labels(px.withColumn("label", (F.col("value") > 30).cast("long")), shape)


# Sequential kernels: no SQL; tests compare them with naive versions and with the undivided graph.


def _register_partitions():
    plain = {
        "multicut_greedy_additive": partition.greedy_additive_multicut, "multicut_greedy_fixation": partition.greedy_fixation_multicut,
        "multicut_kernighan_lin": partition.kernighan_lin_multicut, "multicut_fusion_move": partition.fusion_move_multicut,
    }
    for name, solver in plain.items():
        QUERIES[name] = lambda spark, d, solver=solver: solver(*region_graph(spark, d))
    for linkage in ("sum", "mean", "max", "min", "abs_max", "mutex_watershed"):
        QUERIES[f"gasp_{linkage}"] = lambda spark, d, linkage=linkage: partition.gasp(*region_graph(spark, d), linkage=linkage)


_register_partitions()


@query("edge_weighted_agglomeration")
def edge_weighted_agglomeration(spark, d):
    nodes, edges = region_graph(spark, d)
    return partition.edge_weighted_agglomeration(nodes.withColumn("size", F.lit(25.0)), edges.withColumn("cost", F.abs("cost")), num_clusters_stop=40)


@query("node_and_edge_weighted_agglomeration")
def node_and_edge_weighted_agglomeration(spark, d):
    nodes, edges = region_graph(spark, d)
    own = nodes.select("node", F.lit(25.0).alias("size"), F.array((F.col("node") % 5).cast("double"), (F.col("node") % 7).cast("double")).alias("features"))
    return partition.node_and_edge_weighted_agglomeration(own, edges.withColumn("cost", F.abs("cost")), num_clusters_stop=40)


@query("lifted_greedy_additive")
def lifted_greedy_additive(spark, d):
    nodes, edges = region_graph(spark, d)
    base = edges.select("edge_id", "u", "v", "cost", F.lit(False).alias("is_lifted"))
    lifted = rag.lifted_edges(edges, grid(spark, d)[0], OFFSETS, grid(spark, d)[1])
    more = lifted.select((F.lit(1 << 40) + F.col("u") * 100_000 + F.col("v")).alias("edge_id"), "u", "v", F.lit(-1.0).alias("cost"), F.lit(True).alias("is_lifted"))
    return partition.lifted_greedy_additive_multicut(nodes, base.unionByName(more))


@query("mutex_watershed_clustering")
def mutex_watershed_clustering(spark, d):
    nodes, edges = region_graph(spark, d)
    return partition.mutex_watershed_clustering(nodes, edges.select("edge_id", "u", "v", F.abs("cost").alias("cost"), (F.col("cost") <= 0).alias("is_mutex")))


@query("mutex_watershed")
def mutex_watershed(spark, d):
    px, shape = grid(spark, d)
    affs = other_affinities(spark, d, OFFSETS[:4])
    noisy = affs.withColumn("affinity", F.col("affinity") + (F.xxhash64("channel", "node_id") % 1000) / 2000)
    return partition.mutex_watershed(px, noisy, OFFSETS[:4], 2, shape, (2, 2))


@query("semantic_mutex_watershed_clustering")
def semantic_mutex_watershed_clustering(spark, d):
    nodes, edges = region_graph(spark, d)
    pairs = edges.select("edge_id", "u", "v", F.abs("cost").alias("cost"), (F.col("cost") <= 0).cast("int").alias("kind"))
    tags = nodes.where("node % 9 = 0").select((F.lit(1 << 40) + F.col("node")).alias("edge_id"), F.col("node").alias("u"), F.col("node").alias("v"),
                                              F.lit(5.0).alias("cost"), (2 + F.col("node") % 2).cast("int").alias("kind"))
    every = pairs.unionByName(tags)
    labels = partition.semantic_mutex_watershed_clustering(nodes, every)
    return labels.join(partition.semantic_classes(nodes, every).withColumnRenamed("label", "class"), "node")


@query("edge_weighted_watershed")
def edge_weighted_watershed(spark, d):
    nodes, edges = region_graph(spark, d)
    seeded = nodes.withColumn("seed", F.when(F.col("node") % 37 == 0, F.col("node") + 1).otherwise(0))
    return partition.edge_weighted_watershed(seeded, edges.withColumn("cost", -F.col("cost")))


@query("watershed")
def watershed(spark, d):
    px, shape = grid(spark, d)
    return partition.watershed(px.withColumn("seed", F.when(F.col("node_id") % 211 == 0, F.col("node_id") + 1).otherwise(0)), shape)




@query("median_agglomeration")
def median_agglomeration(spark, d):
    nodes, edges = region_graph(spark, d)
    scaled = edges.withColumn("cost", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (50 - F.col("cost")) / 100)))
    return partition.median_agglomeration(nodes, scaled)


@query("watershed_from_affinities")
def watershed_from_affinities(spark, d):
    px, shape = grid(spark, d)
    affs = px.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"), "node_id", (1 / (1 + F.col("value"))).alias("affinity"))
    seeded = px.withColumn("seed", F.when(F.col("node_id") % 211 == 0, F.col("node_id") + 1).otherwise(0))
    return partition.watershed_from_affinities(seeded, affs, [(1, 0), (0, 1)], shape)


@query("flow_density")
def flow_density(spark, d):
    px, shape = grid(spark, d)
    pull = px.select("node_id", "z", "y", "x", (F.col("value") > 5).alias("fg"), F.lit(0.0).alias("fz"),
                     (2.0 - F.col("y") % 5).alias("fy"), (2.0 - F.col("x") % 5).alias("fx"))
    return flow.flow_density(pull, shape)


@query("lifted_kernighan_lin")
def lifted_kernighan_lin(spark, d):
    nodes, edges = region_graph(spark, d)
    base = edges.select("edge_id", "u", "v", "cost", F.lit(False).alias("is_lifted"))
    lifted = rag.lifted_edges(edges, grid(spark, d)[0], OFFSETS, grid(spark, d)[1])
    more = lifted.select((F.lit(1 << 40) + F.col("u") * 100_000 + F.col("v")).alias("edge_id"), "u", "v", F.lit(-1.0).alias("cost"), F.lit(True).alias("is_lifted"))
    return partition.lifted_kernighan_lin_multicut(nodes, base.unionByName(more))


@query("multicut_chained")
def multicut_chained(spark, d):
    return partition.chained_multicut(*region_graph(spark, d), [kernels.greedy_fixation, kernels.kernighan_lin])


@query("dijkstra_path")
def dijkstra_path(spark, d):
    px, shape = grid(spark, d)
    own = px.select("node_id", "z", "y", "x", (F.col("node_id") == 0).alias("source"), (1 + F.col("value")).alias("cost"))
    return fields.dijkstra_path(own, shape, shape[1] * 100 - 1, 2, mode="node")


@query("geodesic_gradient")
def geodesic_gradient(spark, d):
    px, shape = field_pixels(spark, d)
    return fields.geodesic_gradient(fields.geodesic_distance_field(px, shape), px, shape)


@query("remove_ticks")
def remove_ticks(spark, d):
    vertices, edges = meshes.merge_skeletons(*fragments(spark, d))
    forest = meshes.minimum_spanning_forest(vertices, meshes.skeleton_to_graph(vertices, edges))
    return meshes.remove_ticks(vertices, forest, 2.5)
