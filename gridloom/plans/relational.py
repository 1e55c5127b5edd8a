"""Queries of the relational operators on the test tables, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import affinities as aff
from gridloom.operators import gridgraph, multiset, overlap, rag
from gridloom.operators.blocking import Blocking, blocks_in_slice
from gridloom.sources import tables as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
OFFSETS = [(0, 1), (1, 0), (0, 5), (5, -3), (-1, 0), (4, 4)]
BLOCK = (1, 20, 25)

#: The event grid in SQL.
PX = """px AS (SELECT event_id AS node_id, event_id // 100 AS y, event_id % 100 AS x,
  (event_id // 100) // 5 * 20 + (event_id % 100) // 5 AS label, user_id % 7 AS other, value FROM events),
hw AS (SELECT max(y) + 1 AS h, 100 AS w FROM px)"""
#: Direct contacts of different labels.
CT = """ct AS (SELECT a.node_id, a.y, a.x, b.node_id AS "to", o.dy, least(a.label, b.label) AS u, greatest(a.label, b.label) AS v,
  a.label AS la, a.value AS va, b.value AS vb
  FROM px a, (VALUES (1, 0), (0, 1)) o(dy, dx), px b
  WHERE b.y = a.y + o.dy AND b.x = a.x + o.dx AND a.label <> b.label)"""
ED = "ed AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u, v FROM (SELECT DISTINCT u, v FROM ct))"
OFF = "off(channel, dy, dx) AS (VALUES " + ", ".join(f"({c}, {dy}, {dx})" for c, (dy, dx) in enumerate(OFFSETS)) + ")"
AF = """af AS (SELECT o.channel, o.dy, o.dx, a.node_id, b.node_id AS "to", a.label AS la, b.label AS lb,
  CASE WHEN b.node_id IS NOT NULL AND a.other = b.other THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS aff
  FROM px a CROSS JOIN off o LEFT JOIN px b ON b.y = a.y + o.dy AND b.x = a.x + o.dx)"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def grid(spark, d):
    return t.event_grid(spark, d), t.event_shape(spark, d)


def other_affinities(spark, d, offsets=OFFSETS):
    """Affinities of the grid's other labels: the channels that the affinity features read."""
    px, shape = grid(spark, d)
    return aff.compute_affinities(px.drop("label").withColumnRenamed("other", "label"), offsets, shape)


def rounded(df, *columns, digits=6):
    """df with columns rounded, without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


R = "round({0}, 6) AS {0}".format


@query("rag_edges", w(PX, CT, ED) + "SELECT edge_id, u, v FROM ed")
def rag_edges(spark, d):
    return rag.region_adjacency_graph(*grid(spark, d))


SIMPLE = "round(avg(val), 6) + 0.0 AS mean, count(*) AS size"
FULL = """round(avg(val), 6) + 0.0 AS mean, round(quantile_cont(val, 0.5), 6) + 0.0 AS median, round(stddev_pop(val), 6) + 0.0 AS std, min(val) AS min,
 max(val) AS max, """ + ", ".join(f"round(quantile_cont(val, {p / 100}), 6) AS p{p}" for p in rag.PERCENTILES) + ", count(*) AS size"
FULL_COLUMNS = ["mean", "median", "std", *(f"p{p}" for p in rag.PERCENTILES)]


@query("rag_edge_features", w(PX, CT) + f"SELECT u, v, {SIMPLE} FROM (SELECT u, v, 0.5 * (va + vb) AS val FROM ct) GROUP BY u, v")
def rag_edge_features(spark, d):
    return rounded(rag.edge_map_features(*grid(spark, d)), "mean")


@query("edge_map_features_complex", w(PX, CT) + f"SELECT u, v, {FULL} FROM (SELECT u, v, 0.5 * (va + vb) AS val FROM ct) GROUP BY u, v")
def edge_map_features_complex(spark, d):
    return rounded(rag.edge_map_features(*grid(spark, d), full=True), *FULL_COLUMNS)


HITS = "hits AS (SELECT least(la, lb) AS u, greatest(la, lb) AS v, aff AS val FROM af WHERE la <> lb)"


@query("affinity_features", w(PX, CT, ED, OFF, AF, HITS) + f"""SELECT u, v, {SIMPLE} FROM hits
WHERE (u, v) IN (SELECT (u, v) FROM ed) GROUP BY u, v""")
def affinity_features(spark, d):
    px, shape = grid(spark, d)
    edges = rag.region_adjacency_graph(px, shape)
    return rounded(rag.affinity_features(edges, px, other_affinities(spark, d), OFFSETS, shape), "mean")


@query("affinity_features_complex", w(PX, CT, ED, OFF, AF, HITS) + f"""SELECT u, v, {FULL} FROM hits
WHERE (u, v) IN (SELECT (u, v) FROM ed) GROUP BY u, v""")
def affinity_features_complex(spark, d):
    px, shape = grid(spark, d)
    edges = rag.region_adjacency_graph(px, shape)
    return rounded(rag.affinity_features(edges, px, other_affinities(spark, d), OFFSETS, shape, full=True), *FULL_COLUMNS)


LIFTED = """lifted AS (SELECT DISTINCT least(la, lb) AS u, greatest(la, lb) AS v FROM af
  WHERE la <> lb AND abs(dy) + abs(dx) > 1 AND (least(la, lb), greatest(la, lb)) NOT IN (SELECT (u, v) FROM ed))"""


@query("lifted_edges_from_affinities", w(PX, CT, ED, OFF, AF, LIFTED) + "SELECT u, v FROM lifted")
def lifted_edges_from_affinities(spark, d):
    px, shape = grid(spark, d)
    return rag.lifted_edges(rag.region_adjacency_graph(px, shape), px, OFFSETS, shape)


@query("lifted_affinity_features", w(PX, CT, ED, OFF, AF, LIFTED, HITS) + f"""SELECT u, v, {SIMPLE} FROM hits
WHERE (u, v) IN (SELECT (u, v) FROM lifted) GROUP BY u, v""")
def lifted_affinity_features(spark, d):
    px, shape = grid(spark, d)
    lifted = rag.lifted_edges(rag.region_adjacency_graph(px, shape), px, OFFSETS, shape)
    return rounded(rag.lifted_affinity_features(lifted, px, other_affinities(spark, d), OFFSETS, shape), "mean")


@query("accumulate_labels", w(PX) + """SELECT label, other AS majority FROM (
  SELECT label, other, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, other) AS r FROM px GROUP BY label, other
) WHERE r = 1""")
def accumulate_labels(spark, d):
    return rag.accumulate_labels(grid(spark, d)[0])


@query("accumulate_labels_ignore", w(PX) + """SELECT l.label, coalesce(m.other, 0) AS majority FROM (SELECT DISTINCT label FROM px) l LEFT JOIN (
  SELECT label, other, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, other) AS r FROM px WHERE other <> 3 GROUP BY label, other
) m ON l.label = m.label AND r = 1""")
def accumulate_labels_ignore(spark, d):
    return rag.accumulate_labels(grid(spark, d)[0], ignore_value=3)


@query("project_node_labels", w(PX) + "SELECT node_id, label % 17 AS value FROM px")
def project_node_labels(spark, d):
    px, _ = grid(spark, d)
    labels = px.select("label").distinct().withColumn("node_label", F.col("label") % 17)
    return rag.project_node_labels(px.select("node_id", "label"), labels)


CO = """co AS (SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY node_id, CASE WHEN dy = 1 THEN 0 ELSE 1 END) - 1 AS contact_no,
  CASE WHEN la = ed.u THEN node_id ELSE "to" END AS low, CASE WHEN la = ed.u THEN "to" ELSE node_id END AS high
  FROM ct JOIN ed ON ct.u = ed.u AND ct.v = ed.v),
cs AS (SELECT edge_id, contact_no, 1 AS side, low AS node_id FROM co UNION ALL SELECT edge_id, contact_no, 2, high FROM co)"""


def contact_points(spark, d):
    px, shape = grid(spark, d)
    return px, rag.rag_coordinates(px, shape, rag.region_adjacency_graph(px, shape))


@query("rag_contacts", w(PX, CT, ED, CO) + "SELECT * FROM cs")
def rag_contacts(spark, d):
    return contact_points(spark, d)[1]


@query("rag_storage_lengths", w(PX, CT, ED, CO) + "SELECT edge_id, count(*) AS length FROM cs GROUP BY edge_id")
def rag_storage_lengths(spark, d):
    return rag.storage_lengths(contact_points(spark, d)[1])


@query("edges_to_volume", w(PX, CT, ED, CO) + """SELECT px.node_id, coalesce(p.e * 0.5, -1.0) AS value FROM px LEFT JOIN (
  SELECT node_id, max(edge_id) AS e FROM cs GROUP BY node_id) p ON px.node_id = p.node_id""")
def edges_to_volume(spark, d):
    px, coords = contact_points(spark, d)
    values = coords.select("edge_id").distinct().withColumn("value", F.col("edge_id") * 0.5)
    return rag.edges_to_volume(px, coords, values, ignore_value=-1.0)


BK = "bk AS (SELECT (y // 20) * 4 + x // 25 AS block_id, u, v, 0.5 * (va + vb) AS val FROM ct)"


@query("block_region_edges", w(PX, CT, BK) + "SELECT DISTINCT block_id, u, v FROM bk")
def block_region_edges(spark, d):
    return rag.block_region_edges(*grid(spark, d), BLOCK)


MOMENTS = """CAST(count(*) AS DOUBLE) AS count, round(avg(val), 6) + 0.0 AS mean, round(var_pop(val) * count(*), 7) + 0.0 AS m2, min(val) AS min,
 max(val) AS max"""


def block_stats(spark, d):
    px, shape = grid(spark, d)
    return rag.block_edge_stats(rag.edge_map_values(px, shape), px, shape, BLOCK)


@query("block_edge_stats", w(PX, CT, BK) + f"SELECT block_id, u, v, {MOMENTS} FROM bk GROUP BY block_id, u, v")
def block_edge_stats(spark, d):
    return rounded(rounded(block_stats(spark, d), "mean"), "m2", digits=7)


@query("block_affinity_stats", w(PX, OFF, AF) + f"""SELECT block_id, u, v, {MOMENTS} FROM (
  SELECT (node_id // 100 // 20) * 4 + node_id % 100 // 25 AS block_id, least(la, lb) AS u, greatest(la, lb) AS v, aff AS val
  FROM af WHERE la <> lb) GROUP BY block_id, u, v""")
def block_affinity_stats(spark, d):
    px, shape = grid(spark, d)
    values = rag.affinity_values(px, other_affinities(spark, d), OFFSETS, shape)
    return rounded(rounded(rag.block_edge_stats(values, px, shape, BLOCK), "mean"), "m2", digits=7)


@query("merged_edge_features", w(PX, CT, BK) + """SELECT u, v, round(avg(val), 6) + 0.0 AS mean, round(stddev_pop(val), 6) + 0.0 AS std, min(val) AS min,
 max(val) AS max, count(*) AS size FROM bk GROUP BY u, v""")
def merged_edge_features(spark, d):
    px, shape = grid(spark, d)
    merged = rag.merge_edge_stats(rag.region_adjacency_graph(px, shape), block_stats(spark, d))
    return rounded(rag.finalize_edge_features(merged, full=True), "mean", "std")


@query("merge_edges", """SELECT DISTINCT least(user_id, event_id % 150) AS u, greatest(user_id, event_id % 150) AS v FROM events
WHERE user_id <> event_id % 150""")
def merge_edges(spark, d):
    pairs = t.read(spark, d, "events").select(F.col("user_id").alias("u"), (F.col("event_id") % 150).alias("v"))
    return rag.merge_edges(pairs)


# The implicit grid graph.

GE = """ge AS (SELECT y * w + x AS edge_id, node_id AS u, node_id + w AS v, 1 AS axis, y, x, value FROM px, hw WHERE y < h - 1
  UNION ALL SELECT (h - 1) * w + y * (w - 1) + x, node_id, node_id + 1, 2, y, x, value FROM px, hw WHERE x < w - 1)"""


@query("grid_edges", w(PX, "hw2 AS (SELECT 1)", GE) + "SELECT edge_id, u, v, axis FROM ge")
def grid_edges(spark, d):
    return gridgraph.grid_edges(spark, t.event_shape(spark, d))


@query("grid_project_edge_ids", w(PX, GE) + """SELECT a.axis, px.node_id, coalesce(ge.edge_id, -1) AS edge_id
FROM px CROSS JOIN (VALUES (1), (2)) a(axis) LEFT JOIN ge ON ge.u = px.node_id AND ge.axis = a.axis""")
def grid_project_edge_ids(spark, d):
    return gridgraph.project_edge_ids(spark, t.event_shape(spark, d))


@query("grid_project_offset_edge_ids", w(PX, OFF, AF) + """SELECT channel, node_id, CASE WHEN good
  THEN sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (ORDER BY channel, node_id) - 1 ELSE -1 END :: BIGINT AS edge_id
FROM (SELECT *, "to" IS NOT NULL AND node_id // 100 % 2 = 0 AND node_id % 100 % 3 = 0 AS good FROM af)""")
def grid_project_offset_edge_ids(spark, d):
    px, shape = grid(spark, d)
    return gridgraph.project_offset_edge_ids(px.select("node_id", "z", "y", "x"), OFFSETS, shape, strides=(2, 3))


@query("grid_boundary_features", w(PX, GE) + """SELECT edge_id, 0.5 * (ge.value + px.value) AS weight
FROM ge JOIN px ON px.node_id = ge.v""")
def grid_boundary_features(spark, d):
    return gridgraph.grid_boundary_features(*grid(spark, d))


LOCAL = [(-1, 0), (0, 1), (5, -3)]


@query("grid_affinity_features", w(PX, GE) + """SELECT edge_id, CASE WHEN a.other = b.other THEN 1.0 ELSE 0.0 END AS weight, true AS valid
FROM ge JOIN px a ON a.node_id = ge.u JOIN px b ON b.node_id = ge.v""")
def grid_affinity_features(spark, d):
    rows = other_affinities(spark, d, LOCAL).withColumn("affinity", F.col("affinity").cast("double"))
    return gridgraph.grid_affinity_features(spark, rows, LOCAL, t.event_shape(spark, d))


@query("grid_lifted_edges", w(PX) + """SELECT 2 AS channel, a.node_id, least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v,
CASE WHEN a.other = b.other THEN 1.0 ELSE 0.0 END AS weight FROM px a JOIN px b ON b.y = a.y + 5 AND b.x = a.x - 3""")
def grid_lifted_edges(spark, d):
    rows = other_affinities(spark, d, LOCAL).withColumn("affinity", F.col("affinity").cast("double"))
    return gridgraph.grid_lifted_edges(rows, LOCAL, t.event_shape(spark, d))


# Overlaps and labels: supplier against line number.

OV = "ov AS (SELECT l_suppkey AS label_a, CAST(l_linenumber - 1 AS BIGINT) AS label_b, count(*) AS count FROM lineitem GROUP BY 1, 2)"


def contingency(spark, d):
    rows = t.read(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("label_a"), (F.col("l_linenumber") - 1).cast("long").alias("label_b")
    )
    return overlap.segmentation_overlap(rows)


@query("overlap_table", w(OV) + "SELECT * FROM ov")
def overlap_plain(spark, d):
    return contingency(spark, d)


for _by, _part in (("a", "PARTITION BY label_a"), ("b", "PARTITION BY label_b"), ("total", "")):
    QUERIES[f"overlap_table_{_by}"] = lambda spark, d, by=_by: rounded(overlap.overlap_table(contingency(spark, d), by), "fraction")
    ORACLES[f"overlap_table_{_by}"] = w(OV) + f"SELECT *, round(count / sum(count) OVER ({_part}), 6) + 0.0 AS fraction FROM ov"


@query("overlap_counts_a", w(OV) + "SELECT label_a AS label, CAST(sum(count) AS BIGINT) AS count FROM ov GROUP BY 1")
def overlap_counts_a(spark, d):
    return overlap.counts_table(contingency(spark, d), "a")


@query("overlap_counts_b", w(OV) + "SELECT label_b AS label, CAST(sum(count) AS BIGINT) AS count FROM ov GROUP BY 1")
def overlap_counts_b(spark, d):
    return overlap.counts_table(contingency(spark, d), "b")


@query("overlap_total", w(OV) + "SELECT CAST(sum(count) AS BIGINT) AS total FROM ov")
def overlap_total(spark, d):
    return overlap.total_count(contingency(spark, d))


@query("overlaps_for_label", w(OV) + "SELECT label_b AS label, count, round(count / sum(count) OVER (), 6) + 0.0 AS fraction FROM ov WHERE label_a = 3")
def overlaps_for_label(spark, d):
    return rounded(overlap.overlaps_for_label(contingency(spark, d), 3, "a", True), "fraction")


BEST = """SELECT label, coalesce(best, 0) AS best, coalesce(n, 0) AS count, coalesce(round(n / total, 6), 0.0) AS fraction, best IS NOT NULL AS found
FROM (SELECT label_a AS label, CAST(sum(count) AS BIGINT) AS total FROM ov GROUP BY 1) LEFT JOIN (
  SELECT label_a, label_b AS best, count AS n, row_number() OVER (PARTITION BY label_a ORDER BY count DESC, label_b) AS r FROM ov {0}
) ON label = label_a AND r = 1"""


@query("best_overlap", w(OV) + BEST.format(""))
def best_overlap(spark, d):
    return rounded(overlap.best_overlap(contingency(spark, d)), "fraction")


@query("best_overlap_ignore_zero", w(OV) + BEST.format("WHERE label_b <> 0"))
def best_overlap_ignore_zero(spark, d):
    return rounded(overlap.best_overlap(contingency(spark, d), ignore_zero=True), "fraction")


@query("overlapping_with_zero", w(OV) + "SELECT label_a AS label, bool_or(label_b = 0) AS with_zero FROM ov GROUP BY 1")
def overlapping_with_zero(spark, d):
    return overlap.overlapping_with_zero(contingency(spark, d))


@query("different_overlap", w(OV, "p AS (SELECT label_a, label_b, count / sum(count) OVER (PARTITION BY label_a) AS f FROM ov)") + """
SELECT a.label_a AS u, b.label_a AS v, round(sum(CASE WHEN a.label_b <> b.label_b THEN a.f * b.f ELSE 0 END), 6) + 0.0 AS different
FROM p a JOIN p b ON b.label_a = a.label_a + 1 GROUP BY 1, 2""")
def different_overlap(spark, d):
    table = contingency(spark, d)
    labels = table.select(F.col("label_a").alias("u")).distinct()
    pairs = labels.withColumn("v", F.col("u") + 1).join(labels.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v")
    return rounded(overlap.different_overlap(table, pairs), "different")


@query("take_dict", w(PX) + "SELECT node_id, label, label * 3 + 1 AS value FROM px")
def take_dict(spark, d):
    px, _ = grid(spark, d)
    mapping = px.select(F.col("label").alias("key")).distinct().withColumn("value", F.col("key") * 3 + 1)
    return overlap.take_dict(px.select("node_id", "label"), mapping)


RL = "rl AS (SELECT event_id AS node_id, user_id * user_id % 97 AS label FROM events)"
FW = "fw AS (SELECT label, row_number() OVER (ORDER BY label) + 4 AS relabeled FROM (SELECT DISTINCT label FROM rl WHERE label <> 0))"


def relabel(spark, d):
    rows = t.read(spark, d, "events").select(F.col("event_id").alias("node_id"), (F.col("user_id") * F.col("user_id") % 97).alias("label"))
    return overlap.relabel_sequential(rows, offset=5)


@query("relabel_sequential", w(RL, FW) + "SELECT node_id, rl.label, coalesce(relabeled, 0) AS relabeled FROM rl LEFT JOIN fw ON rl.label = fw.label")
def relabel_sequential(spark, d):
    return relabel(spark, d)[0]


@query("relabel_forward_map", w(RL, FW) + "SELECT label, relabeled FROM fw")
def relabel_forward_map(spark, d):
    return relabel(spark, d)[1]


@query("compute_rle", """WITH m AS (SELECT event_id AS pos, value < 60 AS on_ FROM events),
s AS (SELECT *, CASE WHEN on_ IS DISTINCT FROM lag(on_) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS b FROM m),
r AS (SELECT *, sum(b) OVER (ORDER BY pos) AS g FROM s),
q AS (SELECT g - 1 AS run, bool_or(on_) AS on_, count(*) AS length FROM r GROUP BY g),
f AS (SELECT CASE WHEN on_ THEN 1 ELSE 0 END AS shift FROM q WHERE run = 0)
SELECT CAST(run + shift AS BIGINT) AS run, length FROM q, f UNION ALL SELECT 0, 0 FROM f WHERE shift = 1""")
def compute_rle(spark, d):
    rows = t.read(spark, d, "events").select(F.col("event_id").alias("node_id"), (F.col("value") < 60).alias("mask"))
    return overlap.run_lengths(rows, span=997)


# Multisets.

MS = "ms AS (SELECT (y // 10) * 10 + x // 10 AS block_id, other AS id, count(*) AS count FROM px GROUP BY 1, 2)"
EN = """en AS (SELECT block_id, list(struct_pack(id := id, count := count) ORDER BY id) AS entry,
  arg_max(id, count * 1000 - id) AS argmax FROM ms GROUP BY block_id),
fe AS (SELECT entry, row_number() OVER (ORDER BY min(block_id)) - 1 AS entry_id FROM en GROUP BY entry)"""


def event_multiset(spark, d):
    px, shape = grid(spark, d)
    return multiset.histograms(px, shape, (1, 10, 10), "other"), shape


@query("multiset_histograms", w(PX, MS) + "SELECT * FROM ms")
def multiset_histograms(spark, d):
    return event_multiset(spark, d)[0]


@query("multiset_blocks", w(PX, MS, EN) + "SELECT block_id, argmax, entry_id FROM en JOIN fe ON en.entry = fe.entry")
def multiset_blocks(spark, d):
    return multiset.encode(event_multiset(spark, d)[0])[0]


@query("multiset_entries", w(PX, MS, EN) + "SELECT entry_id, e.id AS id, e.count AS count FROM (SELECT entry_id, unnest(entry) AS e FROM fe)")
def multiset_entries(spark, d):
    entries = multiset.encode(event_multiset(spark, d)[0])[1]
    return entries.select("entry_id", F.explode("entry").alias("e")).select("entry_id", "e.id", "e.count")


DS = "ds AS (SELECT (block_id // 10 // 2) * 5 + block_id % 10 // 2 AS block_id, id, CAST(sum(count) AS BIGINT) AS count FROM ms GROUP BY 1, 2)"


def coarse(spark, d, restrict):
    rows, shape = event_multiset(spark, d)
    blocks, entries = multiset.encode(rows)
    return multiset.downsample(multiset.decode(blocks, entries), (1, -(-shape[1] // 10), 10), (1, 2, 2), restrict)


@query("multiset_downsample", w(PX, MS, DS) + "SELECT * FROM ds")
def multiset_downsample(spark, d):
    return coarse(spark, d, -1)


@query("multiset_topk", w(PX, MS, DS) + "SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY count DESC, id) <= 3")
def multiset_topk(spark, d):
    return coarse(spark, d, 3)


@query("multiset_read_subset", w(PX, MS) + "SELECT id, CAST(sum(count) AS BIGINT) AS count FROM ms WHERE block_id % 3 = 1 GROUP BY id")
def multiset_read_subset(spark, d):
    rows, _ = event_multiset(spark, d)
    return multiset.read_subset(rows, rows.where("block_id % 3 = 1").select("block_id").distinct())


@query("multiset_merger", w(PX, MS, EN) + """SELECT row_number() OVER (ORDER BY grp, first) - 1 AS entry_id, size FROM (
  SELECT entry, min(CASE WHEN block_id % 2 = 0 THEN 0 ELSE 1 END) AS grp, len(entry) AS size,
         coalesce(min(CASE WHEN block_id % 2 = 0 THEN block_id END), min(block_id)) AS first FROM en GROUP BY entry)""")
def multiset_merger(spark, d):
    rows, _ = event_multiset(spark, d)
    _, store = multiset.encode(rows.where("block_id % 2 = 0"))
    _, batch = multiset.encode(rows.where("block_id % 2 = 1"))
    return multiset.merge_entries(store, batch).select("entry_id", F.size("entry").cast("long").alias("size"))


# Blocking.

ROI = Blocking((3, 5), (103, 87), (16, 10), (2, 1))
BL = """bl AS (SELECT by_ * 9 + bx AS block_id, greatest(1 + by_ * 16, 3) AS y0, least(1 + (by_ + 1) * 16, 103) AS y1,
  greatest(4 + bx * 10, 5) AS x0, least(4 + (bx + 1) * 10, 87) AS x1 FROM range(7) a(by_), range(9) b(bx))"""


@query("blocking", w(BL) + "SELECT block_id, y0, y1, x0, x1 FROM bl")
def blocking(spark, d):
    rows = ROI.blocks(spark)
    return rows.select("block_id", *(F.col(c)[k].cast("long").alias(n) for n, c, k in (("y0", "begin", 0), ("y1", "end", 0), ("x0", "begin", 1), ("x1", "end", 1))))


@query("blocks_with_halo", w(BL) + """SELECT block_id, greatest(y0 - 3, 3) AS oy0, least(y1 + 5, 103) AS oy1, greatest(x0 - 2, 5) AS ox0,
least(x1 + 4, 87) AS ox1, y0 - greatest(y0 - 3, 3) AS ly0, x1 - greatest(x0 - 2, 5) AS lx1 FROM bl""")
def blocks_with_halo(spark, d):
    rows = ROI.blocks(spark, (3, 2), (5, 4))
    names = (("oy0", "outer_begin", 0), ("oy1", "outer_end", 0), ("ox0", "outer_begin", 1), ("ox1", "outer_end", 1), ("ly0", "local_begin", 0), ("lx1", "local_end", 1))
    return rows.select("block_id", *(F.col(c)[k].cast("long").alias(n) for n, c, k in names))


@query("blocks_overlapping_box", w(BL) + "SELECT block_id FROM bl WHERE y0 < 60 AND y1 > 20 AND x0 < 45 AND x1 > 14")
def blocks_overlapping_box(spark, d):
    return ROI.in_box(spark, (20, 14), (60, 45), overlapping=True)


@query("blocks_in_box", w(BL) + "SELECT block_id FROM bl WHERE y0 >= 17 AND y1 <= 70 AND x0 >= 10 AND x1 <= 60")
def blocks_in_box(spark, d):
    return ROI.in_box(spark, (17, 10), (70, 60), overlapping=False)


@query("block_neighbors", """SELECT b AS block_id, CASE WHEN b // 9 > 0 THEN b - 9 ELSE -1 END AS up, CASE WHEN b % 9 < 8 THEN b + 1 ELSE -1 END AS "right"
FROM range(63) r(b)""")
def block_neighbors(spark, d):
    b = F.col("block_id")
    return ROI.blocks(spark).select("block_id", ROI.neighbor(b, 0, True).alias("up"), ROI.neighbor(b, 1, False).alias("right"))


@query("block_of_point", w(PX) + "SELECT node_id, ((y - 1) // 16) * 9 + (x - 4) // 10 AS block_id FROM px WHERE y >= 3 AND y < 103 AND x >= 5 AND x < 87")
def block_of_point(spark, d):
    px, _ = grid(spark, d)
    own = px.where("y >= 3 AND y < 103 AND x >= 5 AND x < 87")
    return own.select("node_id", ROI.block_of([F.col("y"), F.col("x")]).alias("block_id"))


@query("blocks_in_slice", w(BL) + "SELECT block_id FROM bl WHERE greatest(y0 - 3, 3) <= 34 AND least(y1 + 3, 103) > 34")
def slice_blocks(spark, d):
    return blocks_in_slice(ROI, spark, 34, (3, 2))


@query("local_overlaps", w(BL, "o AS (SELECT block_id, greatest(y0 - 3, 3) AS y0, least(y1 + 3, 103) AS y1, greatest(x0 - 2, 5) AS x0, least(x1 + 2, 87) AS x1 FROM bl)") + """
SELECT a.block_id AS a, b.block_id AS b, greatest(a.y0, b.y0) - a.y0 AS ya, least(a.x1, b.x1) - b.x0 AS xb
FROM o a JOIN o b ON b.block_id = a.block_id + 9 OR b.block_id = a.block_id + 11
WHERE greatest(a.y0, b.y0) < least(a.y1, b.y1) AND greatest(a.x0, b.x0) < least(a.x1, b.x1)""")
def local_overlaps(spark, d):
    ids = spark.range(ROI.n_blocks).withColumnRenamed("id", "a")
    pairs = ids.select("a", F.explode(F.array(F.col("a") + 9, F.col("a") + 11)).alias("b"))
    found = ROI.local_overlaps(spark, (3, 2), pairs)
    return found.select("a", "b", F.col("begin_a")[0].cast("long").alias("ya"), F.col("end_b")[1].cast("long").alias("xb"))


# Affinities and embeddings.


@query("affinities", w(PX, OFF, AF) + """SELECT channel, node_id, CASE WHEN "to" IS NOT NULL AND la = lb AND la <> 7 THEN 1.0 ELSE 0.0 END AS affinity,
CASE WHEN "to" IS NOT NULL AND la <> 7 AND lb <> 7 THEN 1 ELSE 0 END AS mask FROM af""")
def affinities(spark, d):
    return aff.compute_affinities(*[grid(spark, d)[0], OFFSETS, grid(spark, d)[1]], ignore_label=7)


EM = """em AS (SELECT vec_id AS node_id, vec_id // 25 AS y, vec_id % 25 AS x, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
eo(channel, dy, dx) AS (VALUES (0, 0, 1), (1, 1, 0), (2, -2, 3)),
ep AS (SELECT channel, a.node_id, a.v AS a, b.v AS b FROM em a CROSS JOIN eo LEFT JOIN em b ON b.y = a.y + dy AND b.x = a.x + dx)"""
NORMS = {"l1": "list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))", "l2": "list_distance(a, b)", "cosine": "1 - list_cosine_similarity(a, b)"}

for _norm, _sql in NORMS.items():
    QUERIES[f"embedding_distances_{_norm}"] = lambda spark, d, norm=_norm: rounded(
        aff.compute_embedding_distances(t.embedding_grid(spark, d), [(0, 1), (1, 0), (-2, 3)], t.embedding_shape(spark, d), norm).withColumn(
            "distance", F.col("distance").cast("double")
        ), "distance", digits=3
    )
    ORACLES[f"embedding_distances_{_norm}"] = w(EM) + f"SELECT channel, node_id, round(CAST(CAST(coalesce({_sql}, 0) AS FLOAT) AS DOUBLE), 3) + 0.0 AS distance FROM ep"
