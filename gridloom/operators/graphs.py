"""Undirected graphs as edge tables, and traversals as fixpoints over them.

Edges: (edge_id, u, v), u < v. Loops run on the driver, one round a step; each round's table is written to the shared
folder, which cuts its lineage, and only counts come back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.store import row_numbers, stored


def from_edges(pairs: DataFrame, n_nodes: int | None = None, position: str = "pos") -> DataFrame:
    """(edge_id, u, v) of pairs (pos, u, v): canonical, an edge's id in the order of its first occurrence. Self edges and
    endpoints beyond the nodes are errors."""
    u, v = F.least("u", "v"), F.greatest("u", "v")
    bad = F.col("u") == F.col("v")
    if n_nodes is not None:
        bad |= (v >= n_nodes) | (u < 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no edge: "), F.col("u"), F.lit(" "), F.col("v"))).cast("long")).otherwise(u)
    firsts = pairs.select(position, checked.alias("u"), v.alias("v")).groupBy("u", "v").agg(F.min(position).alias("first"))
    return row_numbers(firsts, ["first"], "edge_id").select("edge_id", "u", "v")


def from_unique_edges(pairs: DataFrame, n_nodes: int | None = None, position: str = "pos") -> DataFrame:
    """As from_edges of pairs that are known to be distinct: ids in the order of ``position``, no shuffle by pair. Self edges
    and endpoints beyond the nodes are errors; a pair that is there twice stays so."""
    u, v = F.least("u", "v"), F.greatest("u", "v")
    bad = F.col("u") == F.col("v")
    if n_nodes is not None:
        bad |= (v >= n_nodes) | (u < 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no edge: "), F.col("u"), F.lit(" "), F.col("v"))).cast("long")).otherwise(u)
    return row_numbers(pairs.select(position, checked.alias("u"), v.alias("v")), [position], "edge_id").select("edge_id", "u", "v")


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label) of a union-find's elements (node, label) after merging pairs (u, v) of elements: label is the least
    element of each set, so ``merged(merged(x, a), b)`` is ``merged(x, a and b)``. Elements that were never merged name
    themselves."""
    old = labels.where("node != label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    found = roots(old.unionByName(pairs.select("u", "v")))
    return labels.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("label"))


def merged_to(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """As merged, but each set is named as its first pair's target (pairs (pos, u, v): u goes to v) was before."""
    own = merged(labels, pairs)
    before = labels.select(F.col("node").alias("v"), F.col("label").alias("name"))
    first = pairs.join(before, "v").join(own.select(F.col("node").alias("v"), F.col("label").alias("set")), "v")
    names = first.groupBy("set").agg(F.min_by("name", "pos").alias("name"))
    out = own.join(names, F.col("label") == F.col("set"), "left").join(labels.select("node", F.col("label").alias("was")), "node")
    return out.select("node", F.coalesce("name", "was").alias("label"))


def find_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with edge_id, -1 where there is no such edge."""
    keyed = edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "edge_id")
    joined = pairs.join(keyed, (F.least("u", "v") == F.col("_u")) & (F.greatest("u", "v") == F.col("_v")), "left")
    return joined.select(*pairs.columns, F.coalesce("edge_id", F.lit(-1).cast("long")).alias("edge_id"))


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(node, neighbor, ...) in both directions."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("neighbor"), *more).unionByName(
        edges.select(F.col("v").alias("node"), F.col("u").alias("neighbor"), *more)
    )


def node_adjacency(edges: DataFrame, node: int) -> DataFrame:
    """(neighbor, edge_id) of a node."""
    return both_ways(edges.where((F.col("u") == node) | (F.col("v") == node)), "edge_id").where(F.col("node") == node).select("neighbor", "edge_id")


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, inner): edges with both ends (inner) or one end among nodes (node)."""
    hits = both_ways(edges, "edge_id").join(nodes.select("node").distinct(), "node", "left_semi")
    return hits.groupBy("edge_id").agg((F.count(F.lit(1)) == 2).alias("inner"))


def edges_from_node_list(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges induced by nodes."""
    return edges.join(subgraph_edges(edges, nodes).where("inner").select("edge_id"), "edge_id", "left_semi")


#: Nodes that a task's union-find holds at most before it sends on its forest and starts afresh.
FOREST_NODES = 500_000


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node it reaches.

    Each task first turns the edges it has into stars by union-find, so a group's many edges are few before any shuffle by
    node. Then large and small stars alternate until only stars are left, in practice a logarithmic number of rounds, each a
    pre-aggregated minimum by node and a join back, whose hot nodes adaptive execution can split. Edges that one task held
    are stars at once.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now.mapInPandas(_forest, "u long, v long").distinct())
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    top = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(top)


def _are_stars(edges: DataFrame) -> bool:
    """Has every u one edge, and is no u another edge's v?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _forest(batches, limit: int = FOREST_NODES):
    """Edges (u, v) as stars around the least node of each group, by union-find in bounded memory."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars() -> pd.DataFrame:
        found = [(x, find(x)) for x in up]
        return pd.DataFrame([e for e in found if e[0] != e[1]], columns=["u", "v"], dtype="int64")

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        if len(up) >= limit:
            yield stars()
            up.clear()
    yield stars()


def connected_components(nodes: DataFrame, edges: DataFrame, start: int = 0) -> DataFrame:
    """(node, label) of nodes (node): dense labels in order of each component's least node; nodes without edges count.
    Leave out edges to mask them."""
    found = nodes.select("node").join(roots(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    found = stored(found)
    labels = row_numbers(found.select("root").distinct(), ["root"], "label", start)
    return found.join(labels, "root").select("node", "label")


def breadth_first_search(edges: DataFrame, source: int, max_distance: int | None = None, include_source: bool = True) -> DataFrame:
    """(node, distance) by hops from source; one round a hop, over the frontier alone."""
    spark = edges.sparkSession
    links = stored(both_ways(edges))
    seen = front = stored(spark.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0).cast("long").alias("distance")))
    hop = 0
    while max_distance is None or hop < max_distance:
        hop += 1
        reached = front.select("node").join(links, "node").select(F.col("neighbor").alias("node")).distinct()
        front = stored(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).cast("long").alias("distance")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if include_source else seen.where("distance > 0")


def lifted_edges_from_node_labels(edges: DataFrame, node_labels: DataFrame, depth: int, mode: str = "all", ignore_label: int | None = None) -> DataFrame:
    """(u, v, distance) of nodes 2 to ``depth`` hops apart, with node_labels (node, label) equal (mode same), different or
    either (all); pairs with the ignored label are left out, but paths through it count.

    All sources advance together; a pair enters with its first distance.
    """
    if mode not in ("all", "same", "different"):
        raise ValueError(f"unknown mode {mode}")
    links = stored(both_ways(edges))
    front = links.select(F.col("node").alias("u"), F.col("neighbor").alias("v"))
    seen = stored(front.withColumn("distance", F.lit(1)))
    front = seen
    for hop in range(2, depth + 1):
        step = front.select("u", F.col("v").alias("node")).join(links, "node").select("u", F.col("neighbor").alias("v"))
        new = step.where("u != v").distinct().join(seen.select("u", "v"), ["u", "v"], "left_anti")
        front = stored(new.withColumn("distance", F.lit(hop)))
        seen = seen.unionByName(front)
    out = seen.where("u < v AND distance >= 2")
    out = out.join(node_labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u")
    out = out.join(node_labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    if ignore_label is not None:
        out = out.where((F.col("lu") != ignore_label) & (F.col("lv") != ignore_label))
    if mode != "all":
        out = out.where("lu = lv" if mode == "same" else "lu != lv")
    return out.select("u", "v", F.col("distance").cast("long").alias("distance"))


def multicut_energy(edges: DataFrame, labels: DataFrame, cost: str = "cost") -> DataFrame:
    """(energy): the sum of the costs of edges whose ends have different labels (node, label)."""
    cut = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v"
    )
    return cut.agg(F.coalesce(F.sum(F.when(F.col("lu") != F.col("lv"), F.col(cost))), F.lit(0.0)).alias("energy"))


def contract(edges: DataFrame, labels: DataFrame, cost: str = "cost") -> DataFrame:
    """(u, v, cost) between labels: ends replaced by their labels, inner edges dropped, parallel ones summed."""
    named = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v"
    )
    return (
        named.where("lu != lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"), cost)
        .groupBy("u", "v").agg(F.sum(cost).alias("cost"))
    )


def agreement_contraction(nodes: DataFrame, edges: DataFrame, proposals: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(labels, contracted edges): nodes joined along every edge whose ends agree in all proposals (node, label)."""
    agree = edges
    for k, p in enumerate(proposals):
        agree = agree.join(p.select(F.col("node").alias("u"), F.col("label").alias(f"a{k}")), "u")
        agree = agree.join(p.select(F.col("node").alias("v"), F.col("label").alias(f"b{k}")), "v").where(f"a{k} = b{k}")
    labels = connected_components(nodes, agree.select("u", "v"))
    return labels, contract(edges, labels)


def lifted_objective(edges: DataFrame, lifted: DataFrame, overwrite: bool = False, bfs_distance: int | None = None) -> DataFrame:
    """(u, v, cost, is_lifted): base edges (u, v, cost) and lifted ones (pos, u, v, cost) as one table. Lifted costs add
    to an existing pair's, or, where ``overwrite``, the last one stands. With ``bfs_distance``, pairs of 2 to so many hops are
    lifted edges too, of cost 0 where ``lifted`` has none."""
    if bfs_distance is not None:
        nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.lit(0))
        near = lifted_edges_from_node_labels(edges, nodes, bfs_distance).select(F.lit(-1).cast("long").alias("pos"), "u", "v", F.lit(0.0).alias("cost"))
        lifted = lifted.select(F.col("pos").cast("long").alias("pos"), "u", "v", "cost").unionByName(near)
    base = edges.select("u", "v", "cost", F.lit(False).alias("is_lifted"), F.lit(-1).cast("long").alias("pos"))
    more = lifted.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cost", F.lit(True).alias("is_lifted"), F.col("pos").cast("long").alias("pos"))
    cost = F.max_by("cost", "pos") if overwrite else F.sum("cost")
    return base.unionByName(more).groupBy("u", "v").agg(cost.alias("cost"), F.min("is_lifted").alias("is_lifted"))
