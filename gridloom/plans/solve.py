"""Planning of sequential graph algorithms: cut the graph where the result cannot depend on it, solve each part in one task.

A kernel takes (n, u, v, weight, more) of one part with nodes 0..n-1 in the order of their ids and edges in the order of
theirs, and returns a label for each node. Parts are components of the edges that ``joins`` selects; other edges between
parts are left out. Labels are made dense over the whole graph by the least node of each cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.store import row_numbers, stored
from gridloom.operators.graphs import roots

Kernel = Callable[..., np.ndarray]


def in_parts(nodes: DataFrame, edges: DataFrame, joins: Column | None) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``part``, edges inside parts with ``part``)."""
    linking = edges if joins is None else edges.where(joins)
    found = roots(linking.select("u", "v"))
    parted = stored(nodes.join(found, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"))
    ends = parted.select("node", "part")
    inner = edges.join(ends.select(F.col("node").alias("u"), "part"), "u").join(
        ends.select(F.col("node").alias("v"), F.col("part").alias("part_v")), "v"
    )
    return parted, inner.where("part = part_v").drop("part_v")


def solve(
    nodes: DataFrame, edges: DataFrame, kernel: Kernel, joins: Column | None = None, columns: tuple[str, ...] = ("cost",),
    node_columns: tuple[str, ...] = (), dense: bool = True, start: int = 0, whole: bool = False, kind: str = "long",
) -> DataFrame:
    """(node, label), label of type ``kind`` where not dense. nodes: (node, *node_columns); edges: (edge_id, u, v, *columns). ``whole`` keeps the graph in one
    part, for settings under which no cut is exact."""
    if whole:
        parted = nodes.withColumn("part", F.lit(0).cast("long"))
        inner = edges.withColumn("part", F.lit(0).cast("long"))
    else:
        parted, inner = in_parts(nodes, edges, joins)
    # A part without edges is one node: its label is its own, no task needed for it.
    alone = None
    if dense and not node_columns:
        with_edges = inner.select("part").distinct()
        alone = parted.join(with_edges, "part", "left_anti").select("node", F.col("node").alias("cluster"))
        parted = parted.join(with_edges, "part", "left_semi")

    def run(key, own: pd.DataFrame, own_edges: pd.DataFrame) -> pd.DataFrame:
        own, own_edges = own.sort_values("node"), own_edges.sort_values("edge_id")
        ids = own["node"].to_numpy()
        u, v = np.searchsorted(ids, own_edges["u"]), np.searchsorted(ids, own_edges["v"])
        labels = np.asarray(
            kernel(len(ids), u, v, *(own_edges[c].to_numpy() for c in columns), *(own[c].to_numpy() for c in node_columns)), dtype=np.int64 if kind == "long" else np.float64
        )
        if dense:  # a cluster's name is its least node
            _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
            labels = ids[first][inverse]
        return pd.DataFrame({"node": ids, "cluster": labels})

    left = parted.select("part", "node", *node_columns)
    right = inner.select(F.col("part").alias("part_e"), "edge_id", "u", "v", *columns)
    out = left.groupBy("part").cogroup(right.groupBy("part_e")).applyInPandas(run, f"node long, cluster {kind}")
    out = stored(out if alone is None else out.unionByName(alone))
    if not dense:
        return out.select("node", F.col("cluster").alias("label"))
    names = row_numbers(out.select("cluster").distinct(), ["cluster"], "label", start)
    return out.join(names, "cluster").select("node", "label")
