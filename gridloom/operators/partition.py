"""Graph partitioning: each sequential kernel on the parts of the graph that its result cannot reach across."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import with_targets
from gridloom.functions.store import stored
from gridloom.operators import kernels
from gridloom.operators.graphs import connected_components
from gridloom.plans.solve import solve


def greedy_additive_multicut(
    nodes: DataFrame, edges: DataFrame, weight_stop: float = 0.0, node_num_stop: float = -1.0, add_noise: bool = False, seed: int = 42, sigma: float = 1.0,
) -> DataFrame:
    """(node, label). By components of positive edges: summed weights between these stay negative, so they never merge. Noise
    of standard deviation ``sigma`` is drawn from each edge's id and ``seed``, whatever the partitioning is."""
    if add_noise:
        even = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "edge_id"), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
        normal = F.sqrt(-2 * F.log(even(0))) * F.cos(2 * math.pi * even(1))
        edges = edges.withColumn("cost", F.col("cost") + sigma * normal)
    whole = weight_stop < 0 or node_num_stop > 0
    kernel = partial(kernels.greedy_additive, weight_stop=weight_stop, node_num_stop=node_num_stop)
    return solve(nodes, edges, kernel, F.col("cost") > 0, whole=whole)


def greedy_fixation_multicut(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return solve(nodes, edges, kernels.greedy_fixation, F.col("cost") > 0)


def decomposed_multicut(nodes: DataFrame, edges: DataFrame, kernel=kernels.kernighan_lin) -> DataFrame:
    """Any kernel (n, u, v, cost) on each component of positive edges: a heuristic for those that could move nodes across."""
    return solve(nodes, edges, kernel, F.col("cost") > 0)


def kernighan_lin_multicut(nodes: DataFrame, edges: DataFrame, outer: int = 100, epsilon: float = 1e-6, decompose: bool = True) -> DataFrame:
    kernel = partial(kernels.kernighan_lin, outer=outer, epsilon=epsilon)
    return solve(nodes, edges, kernel, F.col("cost") > 0, whole=not decompose)


def fusion_move_multicut(
    nodes: DataFrame, edges: DataFrame, iterations: int = 10, stop: int = 4, seed: int = 0, propose=None, solver=kernels.greedy_additive, proposals: int = 1,
) -> DataFrame:
    """Proposals by ``propose`` (kernels.greedy_proposal, kernels.watershed_proposal or any function (rng, n, u, v, cost)), the
    contracted graphs by ``solver``, any kernel (n, u, v, cost)."""
    kernel = partial(kernels.fusion_move, iterations=iterations, stop=stop, seed=seed, propose=propose, solver=solver, proposals=proposals)
    return solve(nodes, edges, kernel, F.col("cost") > 0)


def lifted_fusion_move_multicut(nodes: DataFrame, edges: DataFrame, iterations: int = 10, stop: int = 4, seed: int = 0, propose=None) -> DataFrame:
    """edges: (edge_id, u, v, cost, is_lifted). By components of base edges."""
    kernel = partial(kernels.lifted_fusion_move, iterations=iterations, stop=stop, seed=seed, propose=propose)
    return solve(nodes, edges, kernel, ~F.col("is_lifted"), ("cost", "is_lifted"))


def lifted_chained_multicut(nodes: DataFrame, edges: DataFrame, chain: list) -> DataFrame:
    """Kernels (n, u, v, cost, is_lifted[, start]) one after the other, each but the first with the labels so far."""

    def kernel(n, u, v, cost, is_lifted):
        label = chain[0](n, u, v, cost, is_lifted)
        for step in chain[1:]:
            label = step(n, u, v, cost, is_lifted, start=label)
        return label

    return solve(nodes, edges, kernel, ~F.col("is_lifted"), ("cost", "is_lifted"))


def lifted_greedy_additive_multicut(nodes: DataFrame, edges: DataFrame, weight_stop: float = 0.0) -> DataFrame:
    """edges: (edge_id, u, v, cost, is_lifted). By components of base edges."""
    kernel = partial(kernels.lifted_greedy_additive, weight_stop=weight_stop)
    return solve(nodes, edges, kernel, ~F.col("is_lifted"), ("cost", "is_lifted"))


def lifted_kernighan_lin_multicut(nodes: DataFrame, edges: DataFrame, outer: int | None = None) -> DataFrame:
    """By components of base edges, beyond which no cluster reaches; lifted costs between these are cut whatever is done."""
    return solve(nodes, edges, partial(kernels.lifted_kernighan_lin, outer=outer), ~F.col("is_lifted"), ("cost", "is_lifted"))


def chained_multicut(nodes: DataFrame, edges: DataFrame, chain: list) -> DataFrame:
    """Kernels (n, u, v, cost[, start]) one after the other on each component of positive edges, each but the first with the
    labels so far as ``start``."""

    def kernel(n, u, v, cost):
        label = chain[0](n, u, v, cost)
        for step in chain[1:]:
            label = step(n, u, v, cost, start=label)
        return label

    return solve(nodes, edges, kernel, F.col("cost") > 0)


def mutex_watershed_clustering(nodes: DataFrame, edges: DataFrame, start: int = 0) -> DataFrame:
    """edges: (edge_id, u, v, cost, is_mutex). By components of attractive edges, which alone merge."""
    return solve(nodes, edges, kernels.mutex_watershed, ~F.col("is_mutex"), ("cost", "is_mutex"), start=start)


def grid_mutex_edges(pixels: DataFrame, affinities: DataFrame, offsets, n_attractive: int, shape, strides=None, randomized: bool = False, seed: int = 0) -> DataFrame:
    """(edge_id, u, v, cost, is_mutex) of affinities (channel, node_id, affinity): the first channels attract, the others
    are mutexes; strides thin out the mutexes, or, ``randomized``, as large a share is drawn by pixel and channel. Ids are
    channel-major."""
    keep = pixels.where("mask") if "mask" in pixels.columns else pixels
    rows = with_targets(keep.select("node_id", "z", "y", "x"), offsets, shape)
    if strides is not None:
        on = F.pmod(F.xxhash64(F.lit(seed), "channel", "node_id"), F.lit(math.prod(strides))) == 0 if randomized else F.lit(True)
        for name, s in zip(("z", "y", "x")[-len(strides) :], [] if randomized else strides, strict=not randomized):
            on &= (F.col(name) % s) == 0
        rows = rows.where((F.col("channel") < n_attractive) | on)
    rows = rows.join(keep.select(F.col("node_id").alias("to")), "to", "left_semi")
    found = rows.join(affinities, ["channel", "node_id"])
    n = shape[0] * shape[1] * shape[2]
    return found.select(
        (F.col("channel").cast("long") * n + F.col("node_id")).alias("edge_id"), F.col("node_id").alias("u"), F.col("to").alias("v"),
        F.col("affinity").cast("double").alias("cost"), (F.col("channel") >= n_attractive).alias("is_mutex"),
    )


def mutex_watershed(pixels: DataFrame, affinities: DataFrame, offsets, n_attractive: int, shape, strides=None, randomized: bool = False, seed: int = 0) -> DataFrame:
    """(node_id, label): labels from 1 by least pixel, masked pixels 0."""
    edges = grid_mutex_edges(pixels, affinities, offsets, n_attractive, shape, strides, randomized, seed)
    keep = pixels.where("mask") if "mask" in pixels.columns else pixels
    labels = mutex_watershed_clustering(keep.select(F.col("node_id").alias("node")), edges, start=1)
    out = pixels.select("node_id").join(labels.withColumnRenamed("node", "node_id"), "node_id", "left")
    return out.select("node_id", F.coalesce("label", F.lit(0).cast("long")).alias("label"))


def semantic_mutex_watershed_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): edges (edge_id, u, v, cost, kind) with kind 0 attractive, 1 mutex, 2 + c a node u of class c (v = u)."""

    def kernel(n, u, v, cost, kind):
        return kernels.semantic_mutex_watershed(n, u, v, cost, kind)[0]

    return solve(nodes, edges, kernel, F.col("kind") == 0, ("cost", "kind"))


def semantic_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the class of each node's cluster, -1 without one."""

    def kernel(n, u, v, cost, kind):
        return kernels.semantic_mutex_watershed(n, u, v, cost, kind)[1]

    return solve(nodes, edges, kernel, F.col("kind") == 0, ("cost", "kind"), dense=False)


def semantic_mutex_watershed(
    pixels: DataFrame, affinities: DataFrame, offsets, n_attractive: int, shape, strides=None, randomized: bool = False, mask_label: int = 0, seed: int = 0,
) -> DataFrame:
    """(node_id, label, class). Channels of affinities from the number of offsets on are scores of classes: each pixel asks for
    its best class (all of them on ties). Labels from 1 by least pixel; classes -1 where a cluster has none; masked pixels have
    label 0 and class ``mask_label``."""
    pairs = grid_mutex_edges(pixels, affinities.where(F.col("channel") < len(offsets)), offsets, n_attractive, shape, strides, randomized, seed)
    keep = pixels.where("mask") if "mask" in pixels.columns else pixels
    scores = affinities.where(F.col("channel") >= len(offsets)).join(keep.select("node_id"), "node_id", "left_semi")
    best = scores.join(scores.groupBy("node_id").agg(F.max("affinity").alias("best")), "node_id").where("affinity = best")
    n = shape[0] * shape[1] * shape[2]
    tags = best.select(
        (F.col("channel").cast("long") * n + F.col("node_id")).alias("edge_id"), F.col("node_id").alias("u"), F.col("node_id").alias("v"),
        F.col("affinity").cast("double").alias("cost"), (F.col("channel") - len(offsets) + 2).cast("int").alias("kind"),
    )
    edges = stored(pairs.select("edge_id", "u", "v", "cost", F.col("is_mutex").cast("int").alias("kind")).unionByName(tags))
    nodes = keep.select(F.col("node_id").alias("node"))
    labels = semantic_mutex_watershed_clustering(nodes, edges).join(semantic_classes(nodes, edges).withColumnRenamed("label", "class"), "node")
    out = pixels.select("node_id").join(labels.withColumnRenamed("node", "node_id"), "node_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("node_id", F.coalesce(F.col("label") + 1, zero).alias("label"), F.coalesce("class", F.lit(mask_label).cast("long")).alias("class"))


def gasp(nodes: DataFrame, edges: DataFrame, linkage: str = "mean", num_clusters_stop: int = 1) -> DataFrame:
    """edges: (edge_id, u, v, cost, size[, mergeable]). By components of positive edges while the cluster stop cannot bind. An
    edge that is not mergeable keeps its ends apart when its turn comes."""
    more = ("mergeable",) if "mergeable" in edges.columns else ()

    def kernel(n, u, v, cost, size, mergeable=None):
        return kernels.gasp(n, u, v, cost, size, linkage, num_clusters_stop, mergeable)

    return solve(nodes, edges, kernel, F.col("cost") > 0, ("cost", "size", *more), whole=num_clusters_stop > 1)


def edge_weighted_agglomeration(nodes: DataFrame, edges: DataFrame, num_clusters_stop: int = 1, size_regularizer: float = 1.0) -> DataFrame:
    """edges: (edge_id, u, v, cost, size), nodes: (node, size). A stop above one needs the whole graph in one part."""

    def kernel(n, u, v, cost, edge_size, node_size):
        return kernels.agglomerate(n, u, v, cost, edge_size, node_size, num_clusters_stop, size_regularizer)

    named = nodes.withColumnRenamed("size", "node_size")
    return solve(named, edges, kernel, None, ("cost", "size"), ("node_size",), whole=num_clusters_stop > 1)


def node_and_edge_weighted_agglomeration(nodes: DataFrame, edges: DataFrame, num_clusters_stop: int = 1, beta: float = 0.5, size_regularizer: float = 1.0) -> DataFrame:
    """As edge_weighted_agglomeration, with nodes (node, size, features array<double>)."""

    def kernel(n, u, v, cost, edge_size, node_size, features):
        return kernels.agglomerate(n, u, v, cost, edge_size, node_size, num_clusters_stop, size_regularizer, list(features), beta)

    named = nodes.withColumnRenamed("size", "node_size")
    return solve(named, edges, kernel, None, ("cost", "size"), ("node_size", "features"), whole=num_clusters_stop > 1)


def edge_weighted_watershed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of nodes (node, seed) and edges (edge_id, u, v, cost): by connected component; 0 if no seed reaches."""
    return solve(nodes, edges, kernels.edge_weighted_watershed, None, ("cost",), ("seed",), dense=False)


def label_components(pixels: DataFrame, shape, background: int = 0, connectivity: int | None = None, value: str = "label") -> DataFrame:
    """(node_id, component): pixels of equal value that touch (axis neighbours for connectivity 1, up to all for the number
    of axes); background 0; components numbered from 1 by least pixel."""
    from itertools import product

    axes = 2 if shape[0] == 1 else 3
    most = connectivity or axes
    steps = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and sum(map(abs, o)) <= most and (axes == 3 or o[0] == 0)]
    own = pixels.where(F.col(value) != background).select("node_id", "z", "y", "x", value)
    left = with_targets(own, steps, shape)
    touching = left.join(own.select(F.col("node_id").alias("to"), F.col(value).alias("to_value")), "to")
    edges = touching.where(F.col(value) == F.col("to_value")).select(F.least("node_id", "to").alias("u"), F.greatest("node_id", "to").alias("v"))
    labels = connected_components(own.select(F.col("node_id").alias("node")), edges, start=1)
    out = pixels.select("node_id").join(labels.withColumnRenamed("node", "node_id"), "node_id", "left")
    return out.select("node_id", F.coalesce("label", F.lit(0).cast("long")).alias("component"))


def watershed(pixels: DataFrame, shape, levels: int = 65_536) -> DataFrame:
    """(node_id, label): flooding of heights (value) from markers (seed > 0) within the mask, in order of quantised height,
    last in first out within a level; by component of the mask, with the whole mask's height range."""
    keep = pixels.where("mask") if "mask" in pixels.columns else pixels
    low, high = keep.agg(F.min("value"), F.max("value")).first()
    scale = (levels - 1) / (high - low) if low is not None and high > low else 0.0
    steps = [o for o, n in zip([(1, 0, 0), (0, 1, 0), (0, 0, 1)], shape, strict=True) if n > 1]
    edges = with_targets(keep.select("node_id", "z", "y", "x"), steps, shape).join(keep.select(F.col("node_id").alias("to")), "to", "left_semi")
    edges = edges.select(F.monotonically_increasing_id().alias("edge_id"), F.col("node_id").alias("u"), F.col("to").alias("v"), F.lit(0.0).alias("cost"))

    def kernel(n, u, v, cost, value, seed):
        level = ((value - (low or 0.0)) * scale).astype(np.int64)
        near: list[list[int]] = [[] for _ in range(n)]
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            near[a].append(b)
            near[b].append(a)
        label = seed.astype(np.int64).tolist()
        stacks: dict[int, list[int]] = {}
        for x in range(n):
            if label[x] > 0:
                stacks.setdefault(int(level[x]), []).append(x)
        import heapq

        queue = list(stacks)
        heapq.heapify(queue)
        while queue:
            now = queue[0]
            stack = stacks[now]
            if not stack:
                heapq.heappop(queue)
                del stacks[now]
                continue
            x = stack.pop()
            for y in sorted(near[x]):
                if label[y] == 0:
                    label[y] = label[x]
                    at = max(int(level[y]), now)
                    if at not in stacks:
                        stacks[at] = []
                        heapq.heappush(queue, at)
                    stacks[at].append(y)
        return np.array(label)

    nodes = keep.select(F.col("node_id").alias("node"), F.col("value").cast("double").alias("value"), F.col("seed").cast("long").alias("seed"))
    labels = solve(nodes, edges, kernel, None, ("cost",), ("value", "seed"), dense=False)
    out = pixels.select("node_id").join(labels.withColumnRenamed("node", "node_id"), "node_id", "left")
    return out.select("node_id", F.coalesce("label", F.lit(0).cast("long")).alias("label"))


def median_agglomeration(nodes: DataFrame, edges: DataFrame, num_clusters_stop: int = 1, num_edges_stop: int = 0, threshold: float = 0.5, bins: int = 40) -> DataFrame:
    """edges: (edge_id, u, v, cost) with costs in [0, 1]; a count stop needs the whole graph in one part."""
    kernel = partial(kernels.median_agglomeration, bins=bins, num_clusters_stop=num_clusters_stop, num_edges_stop=num_edges_stop, threshold=threshold)
    return solve(nodes, edges, kernel, None, whole=num_clusters_stop > 1 or num_edges_stop > 0)


def watershed_from_affinities(pixels: DataFrame, affinities: DataFrame, offsets, shape, levels: int = 65_536) -> DataFrame:
    """(node_id, label): flooding from markers (seed > 0) within the mask, the strongest affinity first. Offsets are one
    step along each axis, each axis once; an affinity (channel, node_id, affinity) joins its pixel and the offset's target."""
    keep = pixels.where("mask") if "mask" in pixels.columns else pixels
    own = affinities.join(keep.select("node_id"), "node_id", "left_semi")
    low, high = own.agg(F.min("affinity"), F.max("affinity")).first()
    scale = (levels - 1) / (high - low) if low is not None and high > low else 0.0
    rows = with_targets(keep.select("node_id", "z", "y", "x"), offsets, shape).join(keep.select(F.col("node_id").alias("to")), "to", "left_semi")
    n = shape[0] * shape[1] * shape[2]
    edges = rows.join(own, ["channel", "node_id"]).select(
        (F.col("channel").cast("long") * n + F.col("node_id")).alias("edge_id"), F.col("node_id").alias("u"), F.col("to").alias("v"),
        F.floor((F.lit(high or 0.0) - F.col("affinity")) * scale).cast("long").alias("level"),
    )
    nodes = keep.select(F.col("node_id").alias("node"), F.col("seed").cast("long").alias("seed"))
    labels = solve(nodes, edges, kernels.affinity_watershed, None, ("level",), ("seed",), dense=False)
    out = pixels.select("node_id").join(labels.withColumnRenamed("node", "node_id"), "node_id", "left")
    return out.select("node_id", F.coalesce("label", F.lit(0).cast("long")).alias("label"))
