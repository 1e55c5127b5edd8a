"""Queries about results that SQL can't compute but can hold to account: lengths, energies, connectedness, fixed points.

Each gives a few figures of an operator's result over the whole test grid; the SQL states what these must be, from the tables
alone. The results themselves are the queries of ``plans/graphs.py``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.store import shared_folder, stored
from gridloom.operators import blockskeletons, fields, filaments, graphs, kernels, meshes, meshfields, partition, rag
from gridloom.operators.blocking import Blocking
from gridloom.plans import graphs as g
from gridloom.plans.relational import CT, ED, PX, grid, rounded, w
from gridloom.sources import tables as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def one_row(spark, **figures) -> DataFrame:
    """Figures that are counts or truths, one row."""
    return spark.range(1).select(*(F.lit(v).alias(k) if isinstance(v, bool) else F.lit(v).cast("long").alias(k) for k, v in figures.items()))


# Partitions of the region graph.


def split_clusters(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> int:
    """How many pieces more than clusters (node, label) there are, along edges (u, v)."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    inner = edges.join(of("u"), "u").join(of("v"), "v").where("lu = lv").select("u", "v")
    pieces = graphs.connected_components(nodes.select("node"), inner).select("label").distinct().count()
    return pieces - labels.select("label").distinct().count()


def joinable(edges: DataFrame, labels: DataFrame, linkage) -> int:
    """Adjacent clusters whose edges' common weight is positive."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = edges.join(of("u"), "u").join(of("v"), "v").where("lu != lv")
    pairs = between.groupBy(F.least("lu", "lv").alias("a"), F.greatest("lu", "lv").alias("b")).agg(linkage.alias("weight"))
    return pairs.where("weight > 1e-6").count()


def cost_sum():
    return F.sum("cost")


#: Solvers that end when no two adjacent clusters have a positive common weight, and that weight.
STOPS = {
    "multicut_greedy_additive": cost_sum, "multicut_kernighan_lin": cost_sum, "gasp_sum": cost_sum,
    "gasp_mean": lambda: F.sum(F.col("cost") * F.col("size")), "gasp_max": lambda: F.max("cost"), "gasp_min": lambda: F.min("cost"),
    "gasp_abs_max": lambda: F.max_by("cost", F.abs("cost")),
}


def _register_stops():
    def check(name, linkage):
        def run(spark, d):
            nodes, edges = g.region_graph(spark, d)
            edges, labels = stored(edges), stored(g.QUERIES[name](spark, d))
            return one_row(
                spark, nodes=labels.join(nodes, "node").count(), split=split_clusters(nodes, edges, labels), joinable=joinable(edges, labels, linkage())
            )

        return run

    for name, linkage in STOPS.items():
        sql = w(PX) + "SELECT count(DISTINCT label) AS nodes, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS joinable FROM px"
        query(f"{name}_is_final", sql)(check(name, linkage))


_register_stops()

#: Solvers whose clusters are connected, with the number of clusters where a stop fixes it.
CONNECTED = {
    "multicut_greedy_fixation": None, "multicut_fusion_move": None, "multicut_chained": None, "gasp_mutex_watershed": None,
    "lifted_greedy_additive": None, "lifted_kernighan_lin": None, "mutex_watershed_clustering": None, "median_agglomeration": None,
    "edge_weighted_agglomeration": 40, "node_and_edge_weighted_agglomeration": 40,
}


def _register_connected():
    def check(name, clusters):
        def run(spark, d):
            nodes, edges = g.region_graph(spark, d)
            labels = stored(g.QUERIES[name](spark, d))
            found = labels.select("label").distinct().count()
            return one_row(
                spark, nodes=labels.join(nodes, "node").count(), split=split_clusters(nodes, edges, labels),
                clusters=found if clusters else -1, dense=labels.agg(F.max("label")).first()[0] == found - 1,
            )

        return run

    for name, clusters in CONNECTED.items():
        query(f"{name}_is_connected", w(PX) + f"""SELECT count(DISTINCT label) AS nodes, CAST(0 AS BIGINT) AS split,
CAST({f'least({clusters}, count(DISTINCT label))' if clusters else '-1'} AS BIGINT) AS clusters, TRUE AS dense FROM px""")(check(name, clusters))  # fmt: skip


_register_connected()


@query("multicut_energies_fall", "SELECT TRUE AS greedy, TRUE AS fixation, TRUE AS local_search, TRUE AS fusion, TRUE AS chain")
def multicut_energies_fall(spark, d):
    """Greedy solutions are no worse than single nodes, and what starts from them no worse than they are."""
    _, edges = g.region_graph(spark, d)
    edges = stored(edges)
    energy = lambda name: graphs.multicut_energy(edges, g.QUERIES[name](spark, d)).first()[0]
    single = edges.agg(F.sum("cost")).first()[0]
    greedy, fixation = energy("multicut_greedy_additive"), energy("multicut_greedy_fixation")
    return one_row(
        spark, greedy=greedy <= single, fixation=fixation <= single, local_search=energy("multicut_kernighan_lin") <= greedy + 1e-6,
        fusion=energy("multicut_fusion_move") <= greedy + 1e-6, chain=energy("multicut_chained") <= fixation + 1e-6,
    )


@query("gasp_max_components", g.rec(PX, CT, ED, g.GR, g.RC.replace("cost > 4", "cost > 0")) + "SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS label FROM root")
def gasp_max_components(spark, d):
    """Single linkage joins what positive edges connect."""
    return g.QUERIES["gasp_max"](spark, d)


@query("mutex_watershed_is_gasp", w(PX) + "SELECT count(DISTINCT label) AS nodes, CAST(0 AS BIGINT) AS other FROM px")
def mutex_watershed_is_gasp(spark, d):
    """The mutex watershed of a signed graph is agglomeration by absolute maximum with constraints."""
    a = stored(g.QUERIES["mutex_watershed_clustering"](spark, d))
    b = g.QUERIES["gasp_mutex_watershed"](spark, d).withColumnRenamed("label", "other")
    both = a.join(b, "node")
    return both.agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("label") != F.col("other")).cast("long")).alias("other"))


#: Forest edges of the region graph with all seeds joined to one root, which is -1: those whose ends no lighter edges connect.
SEEDED = """sg AS (SELECT edge_id, u, v, -cost AS wt, CASE WHEN u % 37 = 0 THEN -1 ELSE u END AS a, CASE WHEN v % 37 = 0 THEN -1 ELSE v END AS b FROM gr),
sb AS (SELECT a, b, wt, edge_id FROM sg WHERE a <> b UNION ALL SELECT b, a, wt, edge_id FROM sg WHERE a <> b),
lt(e, wt, node) AS (SELECT edge_id, wt, a FROM sg WHERE a <> b UNION SELECT lt.e, lt.wt, sb.b FROM lt JOIN sb ON lt.node = sb.a
  WHERE sb.wt < lt.wt OR (sb.wt = lt.wt AND sb.edge_id < lt.e)),
fe AS (SELECT u, v FROM sg WHERE a <> b AND NOT EXISTS (SELECT 1 FROM lt WHERE lt.e = sg.edge_id AND lt.node = sg.b)),
fb AS (SELECT u AS a, v AS b FROM fe UNION ALL SELECT v, u FROM fe),
nd AS (SELECT DISTINCT label AS node FROM px),
fl(node, label) AS (SELECT node, node + 1 FROM nd WHERE node % 37 = 0 UNION SELECT fb.b, fl.label FROM fl JOIN fb ON fl.node = fb.a WHERE fb.b % 37 <> 0)"""


@query("edge_weighted_watershed_labels", g.rec(PX, CT, ED, g.GR, SEEDED) + "SELECT nd.node, coalesce(label, 0) AS label FROM nd LEFT JOIN fl ON nd.node = fl.node")
def edge_weighted_watershed_labels(spark, d):
    return g.QUERIES["edge_weighted_watershed"](spark, d)


# Partitions of the grid.


def grid_pieces(px: DataFrame, shape, labels: DataFrame) -> int:
    """Pieces (by axis neighbours) of the labelled pixels (node_id, label), labels other than 0."""
    from gridloom.operators.partition import label_components

    named = px.select("node_id", "z", "y", "x").join(labels, "node_id")
    return label_components(named, shape, connectivity=1).where("component > 0").select("component").distinct().count()


def _register_floods():
    def check(name):
        def run(spark, d):
            px, shape = grid(spark, d)
            labels = stored(g.QUERIES[name](spark, d))
            seeds = labels.where("node_id % 211 = 0")
            return one_row(
                spark, pixels=labels.where("label > 0").count(), labels=labels.select("label").distinct().count(), pieces=grid_pieces(px, shape, labels),
                kept=seeds.where("label = node_id + 1").count() == seeds.count(),
            )

        return run

    for name in ("watershed", "watershed_from_affinities"):
        query(f"{name}_is_complete", w(PX) + """SELECT count(*) AS pixels, count(*) FILTER (node_id % 211 = 0) AS labels,
count(*) FILTER (node_id % 211 = 0) AS pieces, TRUE AS kept FROM px""")(check(name))  # fmt: skip


_register_floods()


@query("mutex_watershed_is_connected", w(PX) + "SELECT count(*) AS pixels, TRUE AS connected, TRUE AS dense FROM px")
def mutex_watershed_is_connected(spark, d):
    px, shape = grid(spark, d)
    labels = stored(g.QUERIES["mutex_watershed"](spark, d))
    n, top = labels.select("label").distinct().count(), labels.agg(F.max("label")).first()[0]
    return one_row(spark, pixels=labels.where("label > 0").count(), connected=grid_pieces(px, shape, labels) == n, dense=top == n)


@query("flow_density_total", w(PX) + "SELECT CAST(count(*) AS DOUBLE) AS particles, CAST(0 AS BIGINT) AS outside FROM px WHERE value > 5")
def flow_density_total(spark, d):
    """No particle is lost, and none ends outside the foreground."""
    px, _ = grid(spark, d)
    found = g.QUERIES["flow_density"](spark, d).join(px.select("node_id", "value"), "node_id")
    return found.agg(F.sum("density").alias("particles"), F.sum(((F.col("value") <= 5) & (F.col("density") > 0)).cast("long")).alias("outside"))


# Distances.

NB8 = "(VALUES (0, 1), (1, -1), (1, 0), (1, 1), (0, -1), (-1, 1), (-1, 0), (-1, -1)) o(dy, dx)"


def _shortest(pixels: str, weight: str, source: str) -> str:
    """Distances by relaxation, keyed by pixel."""
    return f"""fg AS ({pixels}),
st AS (SELECT a.node_id AS a, b.node_id AS b, {weight} AS wt FROM fg a, {NB8}, fg b WHERE b.y = a.y + dy AND b.x = a.x + dx),
sp(node, dist) USING KEY (node) AS (SELECT node_id, 0.0::DOUBLE FROM fg WHERE {source}
  UNION SELECT st.b, min(sp.dist + st.wt) FROM sp JOIN st ON sp.node = st.a LEFT JOIN recurring.sp r ON r.node = st.b
  WHERE r.dist IS NULL OR sp.dist + st.wt < r.dist GROUP BY st.b)"""


FG = "SELECT node_id, y, x, 1 + value / 50 AS cost FROM px WHERE value > 8"


@query("dijkstra_distances", g.rec(PX, _shortest(FG, "sqrt(dy * dy + dx * dx) * b.cost", "node_id % 1009 = 0")) + """
SELECT fg.node_id, coalesce(round(dist, 6), -1.0) + 0.0 AS distance FROM fg LEFT JOIN sp ON fg.node_id = sp.node""")
def dijkstra_distances(spark, d):
    """``dijkstra_distance_field``, -1 where no source comes."""
    field = g.QUERIES["dijkstra_distance_field"](spark, d)
    return rounded(field.withColumn("distance", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.col("distance"))), "distance")


@query("dijkstra_path_cost", g.rec(PX, _shortest("SELECT node_id, y, x, 1 + value AS cost FROM px", "b.cost", "node_id = 0")) + """
SELECT round(dist, 4) + 0.0 AS cost, TRUE AS joined FROM sp, hw WHERE node = h * 100 - 1""")
def dijkstra_path_cost(spark, d):
    """The path's nodes touch one after the other, and cost what the cheapest path costs."""
    px, _ = grid(spark, d)
    walk = stored(g.QUERIES["dijkstra_path"](spark, d).join(px, "node_id"))
    ahead = walk.select((F.col("step") - 1).alias("step"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    apart = walk.join(ahead, "step").where("abs(y - y1) > 1 OR abs(x - x1) > 1").count()
    cost = F.sum(F.when(F.col("step") > 0, 1 + F.col("value")).otherwise(0.0))
    return rounded(walk.agg(cost.alias("cost"), ((F.max("step") + 1 == F.count(F.lit(1))) & F.lit(apart == 0)).alias("joined")), "cost", digits=4)


@query("predecessor_steps", g.rec(PX, _shortest(FG, "1.0", "node_id % 1009 = 0").replace(NB8, "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx)")) + """
SELECT (SELECT count(*) FROM fg) AS pixels, (SELECT count(*) FROM sp) AS reached, CAST(0 AS BIGINT) AS wrong""")
def predecessor_steps(spark, d):
    """Each pixel that a source reaches is one step further than its predecessor; the others have none."""
    px, shape = g.field_pixels(spark, d)
    before = stored(g.QUERIES["dijkstra_predecessors"](spark, d))
    field = stored(fields.dijkstra_distance_field(px, shape, 1))
    rows = before.join(field, "node_id").join(field.toDF("predecessor", "d0"), "predecessor", "left")
    source = F.col("node_id") % 1009 == 0
    right = F.when(source, F.col("predecessor") == F.col("node_id")).when(F.col("predecessor") < 0, F.col("distance") == float("inf"))
    right = right.otherwise(F.col("distance") == F.col("d0") + 1)
    return rows.agg(
        F.count(F.lit(1)).alias("pixels"), F.sum((F.col("predecessor") >= 0).cast("long")).alias("reached"),
        F.sum((~F.coalesce(right, F.lit(False))).cast("long")).alias("wrong"),
    )


def axis_neighbours(field: DataFrame, px: DataFrame, name: str) -> DataFrame:
    """px's rows with the least value of field along y and x (inf where there is none)."""
    at = px.select("node_id", "y", "x").join(field, "node_id")
    steps = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    sent = at.withColumn("o", F.explode(steps)).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("o.dy") != 0).alias("vertical"), name)
    low = sent.groupBy("y", "x").agg(F.min(F.when(F.col("vertical"), F.col(name))).alias("a"), F.min(F.when(~F.col("vertical"), F.col(name))).alias("b"))
    inf = F.lit(float("inf"))
    return px.join(field, "node_id").join(low, ["y", "x"], "left").withColumns({"a": F.coalesce("a", inf), "b": F.coalesce("b", inf)})


@query("geodesic_is_fixed_point", w(PX) + "SELECT count(*) AS pixels, CAST(0 AS BIGINT) AS wrong FROM px WHERE value > 8")
def geodesic_is_fixed_point(spark, d):
    """Every pixel's arrival time follows from its neighbours' by the first-order scheme; sources are at 0."""
    px, _ = g.field_pixels(spark, d)
    rows = axis_neighbours(stored(g.QUERIES["geodesic_distance_field"](spark, d)), px, "distance")
    s, low, high = 1 / F.col("speed"), F.least("a", "b"), F.greatest("a", "b")
    both = (low + high + F.sqrt(F.greatest(2 * s * s - (high - low) * (high - low), F.lit(0.0)))) / 2
    want = F.when(F.col("source"), 0.0).when(low == float("inf"), low).when(high - low >= s, low + s).otherwise(both)
    wrong = ~((F.col("distance") == want) | (F.abs(F.col("distance") - want) < 1e-9))
    return rows.agg(F.count(F.lit(1)).alias("pixels"), F.sum(wrong.cast("long")).alias("wrong"))


@query("geodesic_gradient_is_downhill", w(PX) + "SELECT count(*) AS pixels, CAST(0 AS BIGINT) AS wrong FROM px WHERE value > 8")
def geodesic_gradient_is_downhill(spark, d):
    """The slopes' sizes are the field's falls towards its least neighbour along each axis."""
    px, _ = g.field_pixels(spark, d)
    field = stored(g.QUERIES["geodesic_distance_field"](spark, d))
    rows = axis_neighbours(field, px, "distance").join(g.QUERIES["geodesic_gradient"](spark, d), "node_id")
    fall = lambda n: F.when((F.col(n) < F.col("distance")) & (F.col("distance") < float("inf")), F.col("distance") - F.col(n)).otherwise(0.0)
    wrong = (F.abs(F.abs("gy") - fall("a")) > 1e-4) | (F.abs(F.abs("gx") - fall("b")) > 1e-4) | (F.col("gz") != 0)
    return rows.agg(F.count(F.lit(1)).alias("pixels"), F.sum(wrong.cast("long")).alias("wrong"))


@query("vector_difference_lengths", w(PX) + """SELECT a.node_id, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS length2, TRUE AS hits
FROM px a, px b WHERE b.value < 1 GROUP BY a.node_id""")
def vector_difference_lengths(spark, d):
    """Squared lengths of the vectors, and whether they lead to a zero of the map."""
    px, _ = grid(spark, d)
    v = g.QUERIES["vector_difference_transform"](spark, d).join(px.select("node_id", "y", "x"), "node_id")
    zero = px.where("value < 1").select(F.col("y").alias("y0"), F.col("x").alias("x0"))
    met = v.join(zero, (F.col("y") + F.col("vy") == F.col("y0")) & (F.col("x") + F.col("vx") == F.col("x0")), "left")
    return met.select("node_id", (F.col("vy") ** 2 + F.col("vx") ** 2).cast("long").alias("length2"), F.col("y0").isNotNull().alias("hits"))


# Skeletons and surfaces.


@query("teasar_is_forest", w(PX) + """SELECT count(DISTINCT 0) AS labels, CAST(0 AS BIGINT) AS outside, TRUE AS trees, CAST(0 AS BIGINT) AS long_steps FROM px WHERE value > 30""")
def teasar_is_forest(spark, d):
    """Vertices are pixels of their label, each piece has one root, and a vertex touches its parent."""
    px, _ = grid(spark, d)
    sk = stored(g.QUERIES["teasar_labels"](spark, d))
    on = sk.join(px.select("y", "x", "value"), ["y", "x"], "left")
    up = sk.select("label", "component", F.col("vertex_id").alias("parent"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    long_steps = sk.join(up, ["label", "component", "parent"]).where("abs(y - y1) > 1 OR abs(x - x1) > 1").count()
    roots = sk.where("parent < 0").groupBy("label", "component").count()
    pieces = sk.select("label", "component").distinct().count()
    return one_row(
        spark, labels=sk.select("label").distinct().count(), outside=on.where("value IS NULL OR value <= 30").count(),
        trees=roots.where("count != 1").count() == 0 and roots.count() == pieces, long_steps=long_steps,
    )


def skeleton_blocks(spark, d):
    """Bright pixels as one label, in blocks of 8 x 32."""
    px, shape = grid(spark, d)
    return px.where("value > 30").select("z", "y", "x", F.lit(1).alias("label")), Blocking((0, 0, 0), shape, (1, 8, 32))


#: A plane of the grid is a line of pixels, and a patch of it a run without thickness: its centroid is its target.
TARGETS = """fg AS (SELECT y, x FROM px WHERE value > 30),
fc AS (SELECT 2 AS axis, j * 4 + x // 32 - 1 AS block_id, 1 AS step, j * 8 AS start, least(8 + 1, h - j * 8) AS len, y AS pos, x AS plane
  FROM (SELECT y, x, y // 8 AS j FROM fg UNION ALL SELECT y, x, y // 8 - 1 FROM fg WHERE y % 8 = 0 AND y > 0), hw WHERE x % 32 = 0 AND x > 0
  UNION ALL SELECT 1, (y // 8 - 1) * 4 + j, 4, j * 32, least(32 + 1, w - j * 32), x, y
  FROM (SELECT y, x, x // 32 AS j FROM fg UNION ALL SELECT y, x, x // 32 - 1 FROM fg WHERE x % 32 = 0 AND x > 0), hw WHERE y % 8 = 0 AND y > 0),
rn AS (SELECT axis, block_id, step, start, len, plane, (min(pos) + max(pos)) / 2.0 - start AS m
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY axis, block_id ORDER BY pos) AS run FROM fc) GROUP BY axis, block_id, step, start, len, plane, run),
md AS (SELECT axis, block_id, step, plane, start + CASE WHEN m >= len / 2.0 THEN floor(m) ELSE ceil(m) END AS pos FROM rn),
bt AS (SELECT axis, CAST(block_id AS BIGINT) AS block_id, CAST(block_id + step AS BIGINT) AS neighbor, CAST(1 AS BIGINT) AS label, CAST(0 AS BIGINT) AS z,
  CAST(CASE WHEN axis = 2 THEN pos ELSE plane END AS BIGINT) AS y, CAST(CASE WHEN axis = 2 THEN plane ELSE pos END AS BIGINT) AS x FROM md)"""


@query("block_border_targets", w(PX, TARGETS) + "SELECT * FROM bt")
def block_border_targets(spark, d):
    return blockskeletons.block_border_targets(*skeleton_blocks(spark, d))


def required_points(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.array("block_id", "neighbor")).alias("block_id"), "label", "z", "y", "x").distinct()


@query("block_teasar_keeps_targets", w(PX, TARGETS) + """SELECT count(*) AS targets, CAST(0 AS BIGINT) AS missed, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS long_steps
FROM (SELECT block_id, y, x FROM bt UNION SELECT neighbor, y, x FROM bt)""")
def block_teasar_keeps_targets(spark, d):
    """Every target is a vertex in both of its blocks; vertices are pixels of the mask, edges join neighbours."""
    px, blocking = skeleton_blocks(spark, d)
    wanted = stored(required_points(blockskeletons.block_border_targets(px, blocking)))
    own = stored(blockskeletons.block_teasar(px, blocking, wanted))
    return one_row(
        spark, targets=wanted.count(), missed=wanted.join(own, ["block_id", "label", "z", "y", "x"], "left_anti").count(),
        outside=own.join(px, ["z", "y", "x"], "left_anti").count(), long_steps=own.where("greatest(abs(z - z_to), abs(y - y_to), abs(x - x_to)) > 1").count(),
    )


@query("blockwise_skeletons_are_trees", "SELECT CAST(0 AS BIGINT) AS outside, TRUE AS trees, TRUE AS one_each")
def blockwise_skeletons_are_trees(spark, d):
    """What the blocks' fragments are united to is one tree for each piece of the undivided mask."""
    from gridloom.operators.partition import label_components

    px, blocking = skeleton_blocks(spark, d)
    vertices, edges = (stored(x) for x in blockskeletons.blockwise_skeletons(px, blocking))
    whole, shape = grid(spark, d)
    marked = whole.select("node_id", "z", "y", "x", (F.col("value") > 30).cast("long").alias("label"))
    piece = stored(label_components(marked, shape).where("component > 0").join(marked.select("node_id", "z", "y", "x"), "node_id"))
    pieces = piece.select("component").distinct().count()
    joined = graphs.connected_components(vertices.select(F.col("vertex_id").alias("node")), edges.select("u", "v"))
    met = vertices.join(joined, F.col("vertex_id") == F.col("node")).select("z", "y", "x", joined["label"].alias("tree")).join(piece, ["z", "y", "x"])
    pairs = met.select("tree", "component").distinct().count()
    return one_row(
        spark, outside=vertices.join(px, ["z", "y", "x"], "left_anti").count(), trees=edges.count() == vertices.count() - pieces,
        one_each=pairs == pieces and joined.select("label").distinct().count() == pieces,
    )


@query("marching_cubes_is_closed_inside", w(PX) + "SELECT TRUE AS used, CAST(0 AS BIGINT) AS overused, TRUE AS turned FROM hw")
def marching_cubes_is_closed_inside(spark, d):
    """Every vertex is a corner of a face; no two faces go along an edge in the same direction, and no edge has over two."""
    vertices, faces = (stored(g.QUERIES[f"marching_cubes_{n}"](spark, d)) for n in ("vertices", "faces"))
    sides = F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("a", "b"), ("b", "c"), ("c", "a")))))
    ways = faces.select(sides.alias("s")).select("s.a", "s.b")
    ways = stored(ways.where("a != b"))
    corners = faces.select(F.explode(F.array("a", "b", "c")).alias("vertex_id")).distinct()
    edges = ways.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).count()
    return one_row(
        spark, used=vertices.join(corners, "vertex_id").count() == vertices.count() == corners.count(), overused=edges.where("count > 2").count(),
        turned=ways.groupBy("a", "b").count().where("count > 1").count() == 0,
    )


# Graphs from files, union-find, contraction.


def region_edges(spark, d):
    return rounded(g.region_graph(spark, d)[1].select("edge_id", "u", "v", "cost"), "cost")


@query("text_graph", w(PX, CT, ED, g.GR) + "SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u, v, round(cost, 6) + 0.0 AS cost, (SELECT max(greatest(u, v)) + 1 FROM gr) AS nodes FROM gr")
def text_graph(spark, d):
    """The region graph written as a text file of ``u v cost`` rows and loaded again."""
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    region_edges(spark, d).select(F.col("v").alias("u"), F.col("u").alias("v"), "cost").write.csv(path, sep=" ")
    nodes, edges = t.text_graph(spark, path)
    return edges.withColumn("nodes", F.lit(nodes.count()))


@query("lifted_problem", w(PX, CT, ED, g.GR) + """SELECT row_number() OVER (ORDER BY l, u, v) - 1 AS edge_id, u, v, cost, l AS is_lifted FROM (
SELECT u, v, round(cost, 6) + 0.0 AS cost, FALSE AS l FROM gr UNION ALL SELECT u, v + 100000, -1.0, TRUE FROM gr)""")
def lifted_problem(spark, d):
    path = f"{shared_folder(spark)}/lifted-{uuid.uuid4().hex}"
    edges = region_edges(spark, d)
    edges.write.parquet(f"{path}/local")
    edges.select("u", (F.col("v") + 100_000).alias("v"), F.lit(-1.0).alias("cost")).write.parquet(f"{path}/lifted")
    return t.lifted_problem(spark, path)[1]


@query("graph_from_unique_edges", w(PX, CT, ED, g.GR) + "SELECT row_number() OVER (ORDER BY (u * 7919 + v) % 1000003, u, v) - 1 AS edge_id, u, v FROM gr")
def graph_from_unique_edges(spark, d):
    pairs = g.region_graph(spark, d)[1].select("u", "v")
    rank = F.format_string("%07d-%012d-%012d", (F.col("u") * 7919 + F.col("v")) % 1_000_003, "u", "v")
    return graphs.from_unique_edges(pairs.select(rank.alias("pos"), F.col("v").alias("u"), F.col("u").alias("v")))


#: Sets after merging along edges of cost over 4 and then over 0.
UF = g.RC.replace("cost > 4", "cost > 0")


@query("union_find_merged", g.rec(PX, CT, ED, g.GR, UF) + "SELECT node, root AS label FROM root")
def union_find_merged(spark, d):
    """Two merges, one after the other."""
    nodes, edges = g.region_graph(spark, d)
    first = graphs.merged(nodes.select("node", F.col("node").alias("label")), edges.where("cost > 4"))
    return graphs.merged(stored(first), edges.where("cost > 0"))


@query("union_find_merged_to", w(PX, CT, ED) + """SELECT node, CASE WHEN node % 20 < 19 THEN node - node % 20 + 7 ELSE node END AS label FROM (SELECT DISTINCT label AS node FROM px)""")
def union_find_merged_to(spark, d):
    """The regions of a row of squares, but for its last, go to the eighth: the first pair says so."""
    nodes, _ = g.region_graph(spark, d)
    base = F.col("node") - F.col("node") % 20
    pairs = nodes.where("node % 20 < 19 AND node % 20 != 7").select((F.col("node") % 20).alias("pos"), F.col("node").alias("u"), (base + 7).alias("v"))
    return graphs.merged_to(nodes.select("node", F.col("node").alias("label")), pairs)


AG = """nd AS (SELECT DISTINCT label AS node FROM px),
bw AS (SELECT u AS a, v AS b FROM ed WHERE u // 40 = v // 40 AND u % 20 // 4 = v % 20 // 4 UNION ALL SELECT v, u FROM ed WHERE u // 40 = v // 40 AND u % 20 // 4 = v % 20 // 4),
rc(node, r) AS (SELECT node, node FROM nd UNION SELECT rc.node, bw.b FROM rc JOIN bw ON rc.r = bw.a),
lb AS (SELECT node, dense_rank() OVER (ORDER BY min(r)) - 1 AS label FROM rc GROUP BY node)"""


@query("agreement_contraction", g.rec(PX, CT, ED, g.GR, AG) + """SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, round(sum(cost), 5) + 0.0 AS cost
FROM gr JOIN lb a ON gr.u = a.node JOIN lb b ON gr.v = b.node WHERE a.label <> b.label GROUP BY 1, 2""")
def agreement_contraction(spark, d):
    nodes, edges = g.region_graph(spark, d)
    proposals = [nodes.select("node", F.expr("node div 40").alias("label")), nodes.select("node", F.expr("node % 20 div 4").alias("label"))]
    return rounded(graphs.agreement_contraction(nodes, edges, proposals)[1], "cost", digits=5)


# Solvers with options.


def lifted_graph(spark, d):
    nodes, edges = g.region_graph(spark, d)
    base = edges.select("edge_id", "u", "v", "cost", F.lit(False).alias("is_lifted"))
    px, shape = grid(spark, d)
    lifted = rag.lifted_edges(edges, px, g.OFFSETS, shape)
    more = lifted.select((F.lit(1 << 40) + F.col("u") * 100_000 + F.col("v")).alias("edge_id"), "u", "v", F.lit(-1.0).alias("cost"), F.lit(True).alias("is_lifted"))
    return nodes, stored(base.unionByName(more))


def plain_query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@plain_query("lifted_fusion_move")
def lifted_fusion_move(spark, d):
    return partition.lifted_fusion_move_multicut(*lifted_graph(spark, d))


@plain_query("lifted_chained")
def lifted_chained(spark, d):
    return partition.lifted_chained_multicut(*lifted_graph(spark, d), [kernels.lifted_greedy_additive, kernels.lifted_kernighan_lin, kernels.lifted_fusion_move])


@plain_query("multicut_fusion_watershed_proposals")
def multicut_fusion_watershed_proposals(spark, d):
    return partition.fusion_move_multicut(*g.region_graph(spark, d), propose=kernels.watershed_proposal, proposals=2)


@plain_query("multicut_greedy_noisy")
def multicut_greedy_noisy(spark, d):
    return partition.greedy_additive_multicut(*g.region_graph(spark, d), add_noise=True, sigma=2.0)


@plain_query("gasp_not_mergeable")
def gasp_not_mergeable(spark, d):
    nodes, edges = g.region_graph(spark, d)
    return partition.gasp(nodes, edges.withColumn("mergeable", (F.col("u") + F.col("v")) % 3 != 0), linkage="max")


@query("lifted_energies_fall", w(PX) + "SELECT count(DISTINCT label) AS nodes, TRUE AS fusion, TRUE AS chain, CAST(0 AS BIGINT) AS split FROM px")
def lifted_energies_fall(spark, d):
    nodes, edges = lifted_graph(spark, d)
    greedy = graphs.multicut_energy(edges, partition.lifted_greedy_additive_multicut(nodes, edges)).first()[0]
    fusion, chain = (stored(QUERIES[n](spark, d)) for n in ("lifted_fusion_move", "lifted_chained"))
    energy = lambda x: graphs.multicut_energy(edges, x).first()[0] <= greedy + 1e-6
    base = edges.where("NOT is_lifted")
    return one_row(spark, nodes=nodes.join(fusion, "node").count(), fusion=energy(fusion), chain=energy(chain),
                   split=split_clusters(nodes, base, fusion) + split_clusters(nodes, base, chain))


@query("solver_options", w(PX) + "SELECT count(DISTINCT label) AS nodes, TRUE AS no_worse, TRUE AS connected, TRUE AS kept_apart FROM px")
def solver_options(spark, d):
    """Watershed proposals give no worse energy than greedy joining; noisy and constrained clusters are connected; ends of an
    edge that is not mergeable and outweighs all that it competes with stay apart."""
    nodes, edges = g.region_graph(spark, d)
    edges = stored(edges)
    greedy = graphs.multicut_energy(edges, g.QUERIES["multicut_greedy_additive"](spark, d)).first()[0]
    fused = stored(QUERIES["multicut_fusion_watershed_proposals"](spark, d))
    noisy, apart = (stored(QUERIES[n](spark, d)) for n in ("multicut_greedy_noisy", "gasp_not_mergeable"))
    top = edges.orderBy(F.col("cost").desc()).where("(u + v) % 3 = 0 AND cost > 0").limit(1)
    strongest = edges.agg(F.max("cost")).first()[0]
    ends = [r["label"] for r in top.where(F.col("cost") == strongest).select(F.explode(F.array("u", "v")).alias("node")).join(apart, "node").collect()]  # one edge
    return one_row(
        spark, nodes=fused.join(nodes, "node").count(), no_worse=graphs.multicut_energy(edges, fused).first()[0] <= greedy + 1e-6,
        connected=split_clusters(nodes, edges, noisy) + split_clusters(nodes, edges, apart) == 0, kept_apart=len(set(ends)) == len(ends),
    )


@plain_query("semantic_mutex_watershed")
def semantic_mutex_watershed(spark, d):
    px, shape = grid(spark, d)
    n = 4
    affs = g.other_affinities(spark, d, g.OFFSETS[:n])
    noisy = affs.withColumn("affinity", F.col("affinity") + (F.xxhash64("channel", "node_id") % 1000) / 2000).select("channel", "node_id", "affinity")
    score = lambda k: F.struct(F.lit(n + k).alias("channel"), (F.pmod(F.col("other") + k, F.lit(3)) / 4).alias("affinity"))
    classes = px.select("node_id", F.explode(F.array(score(0), score(1))).alias("s")).select("s.channel", "node_id", "s.affinity")
    masked = px.withColumn("mask", F.col("value") > 1)
    return partition.semantic_mutex_watershed(masked, noisy.unionByName(classes), g.OFFSETS[:n], 2, shape, (2, 2), randomized=True, mask_label=-7)


@query("semantic_mutex_watershed_is_consistent", w(PX) + """SELECT count(*) FILTER (value > 1) AS pixels, count(*) FILTER (value <= 1) AS masked,
TRUE AS connected, CAST(0 AS BIGINT) AS mixed, TRUE AS dense, CAST(0 AS BIGINT) AS unknown FROM px""")
def semantic_mutex_watershed_is_consistent(spark, d):
    """Labels are connected and dense, with one class each; masked pixels have label 0 and the mask's class."""
    px, shape = grid(spark, d)
    out = stored(semantic_mutex_watershed(spark, d))
    own = out.where("label > 0")
    n = own.select("label").distinct().count()
    return one_row(
        spark, pixels=own.count(), masked=out.where("label = 0 AND class = -7").count(), connected=grid_pieces(px, shape, out.select("node_id", "label")) == n,
        mixed=own.groupBy("label").agg(F.count_distinct("class").alias("k")).where("k > 1").count(), dense=own.agg(F.max("label")).first()[0] == n,
        unknown=own.where("class NOT IN (-1, 0, 1)").count(),
    )


# Points, meshes and filaments.


@plain_query("geodesic_distances")
def geodesic_distances(spark, d):
    px, shape = g.field_pixels(spark, d)
    return fields.geodesic_distances(px, px.where("source").select(F.col("node_id").alias("point_id"), "node_id"), shape)


@query("geodesic_distances_match_fields", w(PX, "p AS (SELECT node_id FROM px WHERE value > 8 AND node_id % 1009 = 0)") + """
SELECT (SELECT count(*) FROM p) * (SELECT count(*) FROM p) AS pairs, TRUE AS symmetric, CAST(0 AS BIGINT) AS wrong""")
def geodesic_distances_match_fields(spark, d):
    """The matrix is symmetric with a diagonal of 0, and its first row the mean of fields from both ends."""
    px, shape = g.field_pixels(spark, d)
    m = stored(geodesic_distances(spark, d))
    back = m.toDF("b", "a", "back")
    odd = m.join(back, ["a", "b"]).where("distance != back OR (a = b AND distance != 0)").count()
    first = m.agg(F.min("a")).first()[0]
    field = fields.geodesic_distance_field(px.withColumn("source", F.col("node_id") == first), shape).select(F.col("node_id").alias("b"), F.col("distance").alias("there"))
    wrong = m.where(F.col("a") == first).join(field, "b").where("(distance < there * 0.8 OR distance > there * 1.25) AND there < double('infinity')").count()
    return one_row(spark, pairs=m.count(), symmetric=odd == 0, wrong=wrong)


TARGETS = (550, 737, 910)


@query("dijkstra_path_to_nearest", g.rec(PX, _shortest("SELECT node_id, y, x, 1 + value AS cost FROM px", "b.cost", "node_id = 0")) + f"""
SELECT node AS target, round(dist, 4) + 0.0 AS cost FROM sp WHERE node IN {TARGETS} ORDER BY dist LIMIT 1""")
def dijkstra_path_to_nearest(spark, d):
    """The path to the cheapest of several targets, and its cost."""
    px, shape = grid(spark, d)
    own = px.select("node_id", "z", "y", "x", (F.col("node_id") == 0).alias("source"), (1 + F.col("value")).alias("cost"))
    walk = fields.dijkstra_path(own, shape, list(TARGETS), 2, mode="node").join(px.select("node_id", "value"), "node_id")
    cost = F.sum(F.when(F.col("step") > 0, 1 + F.col("value")).otherwise(0.0))
    return rounded(walk.agg(F.max_by("node_id", "step").alias("target"), cost.alias("cost")), "cost", digits=4)


@plain_query("mesh_geodesic_field")
def mesh_geodesic_field(spark, d):
    vertices, faces = g.grid_mesh(spark, d)
    flat = vertices.withColumns({"z": F.lit(0.0), "source": F.col("vertex_id") == 0, "speed": F.lit(0.5)})
    return meshfields.geodesic_distance_field_mesh(flat, faces)


@query("mesh_front_bounds", w(PX) + "SELECT count(*) AS vertices, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS crooked FROM px")
def mesh_front_bounds(spark, d):
    """On a flat mesh of speed one half, a front takes twice the straight distance at least, and at most twice the way along
    the axes, which it takes exactly on the axes."""
    px, _ = grid(spark, d)
    rows = mesh_geodesic_field(spark, d).join(px.select(F.col("node_id").alias("vertex_id"), "y", "x"), "vertex_id")
    straight, along = 2 * F.sqrt(F.col("y") * F.col("y") + F.col("x") * F.col("x")), 2.0 * (F.col("y") + F.col("x"))
    wrong = (F.col("distance") < straight - 1e-9) | (F.col("distance") > along + 1e-9)
    crooked = ((F.col("y") == 0) | (F.col("x") == 0)) & (F.abs(F.col("distance") - along) > 1e-9)
    return rows.agg(F.count(F.lit(1)).alias("vertices"), F.sum(wrong.cast("long")).alias("wrong"), F.sum(crooked.cast("long")).alias("crooked"))


@query("mesh_geodesic_distances", w(PX) + """SELECT a.node_id AS a, b.node_id AS b, 2.0 * abs(a.x - b.x) AS distance FROM px a, px b
WHERE a.y = 0 AND b.y = 0 AND a.x % 40 = 0 AND b.x % 40 = 0""")
def mesh_geodesic_distances(spark, d):
    """Between vertices on one side of a flat mesh of speed one half."""
    vertices, faces = g.grid_mesh(spark, d)
    flat = vertices.withColumns({"z": F.lit(0.0), "speed": F.lit(0.5)})
    return rounded(meshfields.geodesic_distances_mesh(flat, faces, flat.where("y = 0 AND x % 40 = 0").select("vertex_id")), "distance")


def filament_graph(spark, d):
    vertices, edges = meshes.merge_skeletons(*g.fragments(spark, d))
    return vertices.select("vertex_id", "z", "y", "x", "label"), stored(meshes.skeleton_to_graph(vertices, edges))


@plain_query("join_close_components")
def join_close_components(spark, d):
    vertices, edges = filament_graph(spark, d)
    return filaments.join_close_components(vertices, edges, 3.5)


@query("joins_connect_components", "SELECT TRUE AS kept, TRUE AS one_each, TRUE AS near")
def joins_connect_components(spark, d):
    """Old edges stay, every new one makes one component of two, and none is longer than the gap allowed."""
    vertices, edges = filament_graph(spark, d)
    after = stored(join_close_components(spark, d))
    linked = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    pieces = lambda e: graphs.connected_components(linked, e.select("u", "v")).select("label").distinct().count()
    new = after.join(edges.select("edge_id"), "edge_id", "left_anti")
    long = meshes.with_lengths(vertices, new).where("length > 3.5 * 3.5").count()
    kept = after.join(edges, ["edge_id", "u", "v"]).count() == edges.count()
    return one_row(spark, kept=kept, one_each=pieces(edges) - pieces(after) == new.count(), near=long == 0)


@plain_query("clean_filament_graph")
def clean_filament_graph(spark, d):
    vertices, edges = filament_graph(spark, d)
    return filaments.clean_filament_graph(vertices.drop("label"), edges, tick_length=1.5, join_dist=2.5)[1]


@query("draw_tubes", w(g.SK, """ed AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u, v, z, y, xu, xv, label FROM (SELECT DISTINCT least(a.vertex_id, b.vertex_id) AS u,
  greatest(a.vertex_id, b.vertex_id) AS v, a.z, a.y, least(a.x, b.x) AS xu, greatest(a.x, b.x) AS xv, a.label
  FROM mv a JOIN mv b ON a.label = b.label AND a.z = b.z AND a.y = b.y AND b.x = (a.x + 1) % 13 WHERE a.vertex_id <> b.vertex_id)),
ln AS (SELECT edge_id, s AS step, z, y, xu + s AS x, label FROM ed, range(0, 13) r(s) WHERE s <= xv - xu),
b(n, dz, dy, dx) AS (VALUES (0, -1, 0, 0), (1, 0, -1, 0), (2, 0, 0, -1), (3, 0, 0, 0), (4, 0, 0, 1), (5, 0, 1, 0), (6, 1, 0, 0))""") + """
SELECT ((z + dz) * 2000 + y + dy) * 13 + x + dx AS node_id, arg_max(label, n::BIGINT * 1000000000 + edge_id * 100 + step) + 1 AS label FROM ln, b
WHERE z + dz BETWEEN 0 AND 10 AND y + dy BETWEEN 0 AND 1999 AND x + dx BETWEEN 0 AND 12 GROUP BY 1""")
def draw_tubes(spark, d):
    vertices, edges = filament_graph(spark, d)
    return filaments.draw_tubes(vertices, edges, vertices.select(F.col("vertex_id").alias("node"), "label"), (11, 2000, 13), 1)
