"""Sequential clustering kernels on one part of a graph: NumPy arrays in, a label for each node out."""

from __future__ import annotations

import heapq
import itertools

import numpy as np


class Clusters:
    """Union-find; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def labels(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))])


class Contraction:
    """A graph under edge contraction: parallel edges are folded by ``fold``."""

    def __init__(self, n: int, u, v, values, fold):
        self.sets = Clusters(n)
        self.fold = fold
        self.links: list[dict[int, object]] = [{} for _ in range(n)]
        for a, b, x in zip(u.tolist(), v.tolist(), values, strict=True):
            if a != b:
                old = self.links[a].get(b)
                self.links[a][b] = self.links[b][a] = x if old is None else fold(old, x)

    def merge(self, a: int, b: int) -> tuple[int, list[int]]:
        """Contract b into a (or a into b, whichever has fewer links); returns the root and its changed neighbours."""
        links = self.links
        if len(links[a]) < len(links[b]):
            a, b = b, a
        del links[a][b], links[b][a]
        self.sets.up[b] = a
        changed = []
        for c, x in links[b].items():
            del links[c][b]
            old = links[a].get(c)
            links[a][c] = links[c][a] = x if old is None else self.fold(old, x)
            changed.append(c)
        links[b] = {}
        return a, changed


def greedy_additive(n, u, v, cost, weight_stop: float = 0.0, node_num_stop: float = -1.0) -> np.ndarray:
    """Contract the heaviest edge while it is over ``weight_stop``; parallel edges add up."""
    graph = Contraction(n, u, v, cost.tolist(), lambda a, b: a + b)
    heap = [(-x, a, b) for a in range(n) for b, x in graph.links[a].items() if a < b and x > weight_stop]
    heapq.heapify(heap)
    left, least = n, node_num_stop if node_num_stop >= 1 else node_num_stop * n
    while heap and left > max(least, 0):
        x, a, b = heapq.heappop(heap)
        if graph.links[a].get(b) != -x:
            continue
        a, changed = graph.merge(a, b)
        left -= 1
        for c in changed:
            y = graph.links[a][c]
            if y > weight_stop:
                heapq.heappush(heap, (-y, min(a, c), max(a, c)))
    return graph.sets.labels()


def greedy_fixation(n, u, v, cost) -> np.ndarray:
    """By absolute weight: positive edges contract, negative ones forbid, and a fold is forbidden if either side is."""
    graph = Contraction(n, u, v, [(x, False) for x in cost.tolist()], lambda a, b: (a[0] + b[0], a[1] or b[1]))
    heap = [(-abs(x[0]), a, b, x) for a in range(n) for b, x in graph.links[a].items() if a < b]
    heapq.heapify(heap)
    while heap:
        _, a, b, x = heapq.heappop(heap)
        if graph.links[a].get(b) != x or x[1]:
            continue
        if x[0] < 0:
            graph.links[a][b] = graph.links[b][a] = (x[0], True)
        elif x[0] > 0:
            a, changed = graph.merge(a, b)
            for c in changed:
                y = graph.links[a][c]
                if not y[1]:
                    heapq.heappush(heap, (-abs(y[0]), min(a, c), max(a, c), y))
    return graph.sets.labels()


def lifted_greedy_additive(n, u, v, cost, is_lifted, weight_stop: float = 0.0) -> np.ndarray:
    """As greedy_additive, but lifted edges contract only once folded with a base edge."""
    values = [(x, not bool(z)) for x, z in zip(cost.tolist(), is_lifted.tolist(), strict=True)]
    graph = Contraction(n, u, v, values, lambda a, b: (a[0] + b[0], a[1] or b[1]))
    heap = [(-x[0], a, b) for a in range(n) for b, x in graph.links[a].items() if a < b and x[1] and x[0] > weight_stop]
    heapq.heapify(heap)
    while heap:
        x, a, b = heapq.heappop(heap)
        if graph.links[a].get(b) != (-x, True):
            continue
        a, changed = graph.merge(a, b)
        for c in changed:
            y = graph.links[a][c]
            if y[1] and y[0] > weight_stop:
                heapq.heappush(heap, (-y[0], min(a, c), max(a, c)))
    return graph.sets.labels()


def kernighan_lin(n, u, v, cost, outer: int = 100, epsilon: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """Local search from ``start`` (greedy_additive's result if none): moves of border nodes between adjacent clusters in
    chains whose best prefix is kept, splits to a new cluster, joins of clusters, until nothing improves by ``epsilon``."""
    label = (greedy_additive(n, u, v, cost) if start is None else np.asarray(start)).tolist()
    links: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, x in zip(u.tolist(), v.tolist(), cost.tolist(), strict=True):
        if a != b:
            links[a].append((b, x))
            links[b].append((a, x))
    fresh = n

    def chain(members: list[int], side_a: int, side_b: int) -> bool:
        """Move single nodes between the two sides, each once, the best first; keep the best prefix."""
        inside = set(members)
        gain = {}
        for x in members:
            own, other = label[x], side_b if label[x] == side_a else side_a
            gain[x] = sum(w for y, w in links[x] if label[y] == other) - sum(w for y, w in links[x] if label[y] == own)
        border = {x for x in members if side_b == -1 or any(label[y] != label[x] and y in inside for y, _ in links[x])}
        moved, total, best, best_at = [], 0.0, epsilon, 0
        target_new = fresh if side_b == -1 else side_b
        heap = [(-gain[x], x) for x in border]
        heapq.heapify(heap)
        done = set()
        while heap:
            g, x = heapq.heappop(heap)
            if x in done or -g != gain[x]:
                continue
            if total + gain[x] < -1e9 or len(moved) > len(members):
                break
            done.add(x)
            old = label[x]
            new = target_new if old == side_a else side_a
            label[x] = new
            total += gain[x]
            moved.append((x, old))
            if total > best:
                best, best_at = total, len(moved)
            for y, w in links[x]:
                if y in inside and y not in done:
                    gain[y] += 2 * w if label[y] == old else -2 * w
                    heapq.heappush(heap, (-gain[y], y))
        for x, old in reversed(moved[best_at:]):
            label[x] = old
        return best_at > 0

    for _ in range(outer):
        improved = False
        groups: dict[int, list[int]] = {}
        for x, c in enumerate(label):
            groups.setdefault(c, []).append(x)
        adjacent = sorted({(min(label[a], label[b]), max(label[a], label[b])) for a in range(n) for b, _ in links[a] if label[a] != label[b]})
        for a, b in adjacent:
            members = [x for x in groups.get(a, []) + groups.get(b, []) if label[x] in (a, b)]
            improved |= chain(members, a, b)
        for c in sorted(set(label)):
            while True:
                members = [x for x in range(n) if label[x] == c] if c not in groups else [x for x in groups[c] if label[x] == c]
                if len(members) < 2 or not chain(members, c, -1):
                    break
                fresh += 1
                improved = True
        # A move can leave a cluster in pieces, which cost nothing to tell apart; joins then go on until no pair gains by one.
        _, pieces = np.unique(split_unconnected(n, u, v, label), return_inverse=True)
        pu, pv = pieces[u], pieces[v]
        joined = greedy_additive(int(pieces.max(initial=-1)) + 1, pu[pu != pv], pv[pu != pv], cost[pu != pv], epsilon)
        improved |= len(np.unique(joined)) < len(joined)
        _, dense = np.unique(joined[pieces], return_inverse=True)
        label[:] = dense.tolist()
        fresh = max(n, max(label, default=0) + 1)
        if not improved:
            break
    return np.array(label)


def energy(u, v, cost, label) -> float:
    return float(cost[label[u] != label[v]].sum())


def greedy_proposal(rng, n, u, v, cost, sigma: float = 1.0) -> np.ndarray:
    """greedy_additive on costs with noise of ``sigma`` times their spread."""
    return greedy_additive(n, u, v, cost + rng.normal(0, sigma * max(float(np.std(cost)), 1e-12), len(cost)))


def watershed_proposal(rng, n, u, v, cost, sigma: float = 1.0, seeds: float = 0.1) -> np.ndarray:
    """Floods from both ends of random negative edges over noisy costs, the most attractive first. ``seeds``: how many, or, up
    to 1, which share of the nodes. All in one if there is no negative edge."""
    negative = np.flatnonzero(cost < 0)
    if not len(negative):
        return np.zeros(n, dtype=np.int64)
    target = max(1, int((n * seeds if seeds <= 1 else seeds) + 0.5))
    seed = np.zeros(n, dtype=np.int64)
    for k, e in enumerate(rng.choice(negative, min(len(negative), max(1, target // 2))).tolist()):
        seed[u[e]], seed[v[e]] = 2 * k + 1, 2 * k + 2
    return edge_weighted_watershed(n, u, v, -(cost + rng.normal(0, sigma, len(cost))), seed)


def agreed(n, u, v, labelings: list[np.ndarray]) -> np.ndarray:
    """Dense names of the nodes joined along every edge whose ends agree in all labelings."""
    same = Clusters(n)
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        if all(x[a] == x[b] for x in labelings):
            a, b = same.find(a), same.find(b)
            if a != b:
                same.up[max(a, b)] = min(a, b)
    return np.unique(same.labels(), return_inverse=True)[1]


def fusion_move(
    n, u, v, cost, iterations: int = 10, stop: int = 4, sigma: float = 1.0, seed: int = 0, propose=None, solver=greedy_additive,
    proposals: int = 1, start: np.ndarray | None = None,
) -> np.ndarray:
    """Fuse proposals (``propose(rng, n, u, v, cost)``; noisy greedy ones if none is given) with the best labels: contract what
    both agree on, solve the rest. Of several proposals a round, those that are no better alone are also fused together. The
    energy never rises; ``stop`` rounds without a fall end the search."""
    rng = np.random.default_rng(seed)
    make = propose or (lambda *a: greedy_proposal(*a, sigma=sigma))
    best = solver(n, u, v, cost) if start is None else np.asarray(start)
    low, idle = energy(u, v, cost, best), 0

    def fused(labelings: list[np.ndarray]) -> np.ndarray:
        dense = agreed(n, u, v, labelings)
        cu, cv = dense[u], dense[v]
        cut = cu != cv
        return solver(int(dense.max(initial=-1)) + 1, cu[cut], cv[cut], cost[cut])[dense]

    for _ in range(iterations):
        made = [make(rng, n, u, v, cost) for _ in range(proposals)]
        candidates = [x for m in made for x in (fused([best, m]), m)]
        if len(made) > 1:
            candidates.append(fused([best, *made]))
        scores = [energy(u, v, cost, x) for x in candidates]
        k = int(np.argmin(scores))
        if scores[k] < low - 1e-12:
            best, low, idle = candidates[k], scores[k], 0
        else:
            idle += 1
            if idle >= stop:
                break
    return best


def lifted_fusion_move(
    n, u, v, cost, is_lifted, iterations: int = 10, stop: int = 4, sigma: float = 1.0, seed: int = 0, propose=None, start: np.ndarray | None = None,
) -> np.ndarray:
    """As fusion_move on base and lifted costs: proposals come from the base graph, nodes join along base edges alone, and the
    rest is solved by lifted_greedy_additive. Clusters end connected by base edges; the energy is never above the start's."""
    rng = np.random.default_rng(seed)
    base = ~is_lifted.astype(bool)
    bu, bv, bc = u[base], v[base], cost[base]
    make = propose or (lambda *a: greedy_proposal(*a, sigma=sigma))
    best = lifted_greedy_additive(n, u, v, cost, is_lifted) if start is None else split_unconnected(n, bu, bv, np.asarray(start))
    low, idle = energy(u, v, cost, best), 0
    for _ in range(iterations):
        proposal = split_unconnected(n, bu, bv, make(rng, n, bu, bv, bc))
        dense = agreed(n, bu, bv, [best, proposal])
        cu, cv = dense[u], dense[v]
        cut = cu != cv
        fused = lifted_greedy_additive(int(dense.max(initial=-1)) + 1, cu[cut], cv[cut], cost[cut], is_lifted[cut])[dense]
        candidates = [split_unconnected(n, bu, bv, fused), proposal]
        scores = [energy(u, v, cost, x) for x in candidates]
        k = int(np.argmin(scores))
        if scores[k] < low - 1e-12:
            best, low, idle = candidates[k], scores[k], 0
        else:
            idle += 1
            if idle >= stop:
                break
    return best


def mutex_watershed(n, u, v, cost, is_mutex) -> np.ndarray:
    """Edges by weight, heaviest first (attractive before mutex, then by id, on ties): attractive ones merge unless a mutex
    stands between the clusters, mutex ones put one there."""
    order = np.lexsort((np.arange(len(u)), is_mutex.astype(bool), -cost))
    sets = Clusters(n)
    against: list[set[int]] = [set() for _ in range(n)]
    for a, b, m in zip(u[order].tolist(), v[order].tolist(), is_mutex[order].tolist(), strict=True):
        a, b = sets.find(a), sets.find(b)
        if a == b:
            continue
        if m:
            against[a].add(b)
            against[b].add(a)
        elif b not in against[a]:
            if len(against[a]) < len(against[b]):
                a, b = b, a
            sets.up[b] = a
            for c in against[b]:
                against[c].discard(b)
                against[c].add(a)
            against[a] |= against[b]
            against[b] = set()
    return sets.labels()


def semantic_mutex_watershed(n, u, v, cost, kind) -> tuple[np.ndarray, np.ndarray]:
    """(labels, classes): kind 0 attractive, 1 mutex, 2 + c an edge of node u to class c (v is ignored). The first class of
    a cluster stays; clusters of different classes never merge."""
    rank = np.minimum(kind, 2)
    order = np.lexsort((np.arange(len(u)), rank, -cost))
    sets = Clusters(n)
    against: list[set[int]] = [set() for _ in range(n)]
    of = [-1] * n
    for a, b, k in zip(u[order].tolist(), v[order].tolist(), kind[order].tolist(), strict=True):
        a = sets.find(a)
        if k >= 2:
            if of[a] < 0:
                of[a] = k - 2
            continue
        b = sets.find(b)
        if a == b or (of[a] >= 0 and of[b] >= 0 and of[a] != of[b]):
            continue
        if k == 1:
            against[a].add(b)
            against[b].add(a)
        elif b not in against[a]:
            sets.up[b] = a
            of[a] = of[a] if of[a] >= 0 else of[b]
            for c in against[b]:
                against[c].discard(b)
                against[c].add(a)
            against[a] |= against[b]
            against[b] = set()
    labels = sets.labels()
    return labels, np.array([of[x] for x in labels.tolist()])


def gasp(n, u, v, weight, size=None, linkage: str = "mean", num_clusters_stop: int = 1, mergeable=None) -> np.ndarray:
    """Agglomeration of signed weights, heaviest first, while positive. Linkage sum, mean (by size), max, min, abs_max, or
    mutex_watershed (abs_max with constraints; ties in mutex_watershed's order). Edges that are not mergeable forbid instead."""
    size = np.ones(len(u)) if size is None else size
    allowed = np.ones(len(u), bool) if mergeable is None else mergeable.astype(bool)
    folds = {
        "sum": lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] and b[2]),
        "mean": lambda a, b: ((a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] and b[2]),
        "max": lambda a, b: (max(a[0], b[0]), a[1] + b[1], a[2] and b[2]),
        "min": lambda a, b: (min(a[0], b[0]), a[1] + b[1], a[2] and b[2]),
        "abs_max": lambda a, b: (a[0] if abs(a[0]) >= abs(b[0]) else b[0], a[1] + b[1], a[2] and b[2]),
    }
    by_size = linkage == "mutex_watershed"
    values = list(zip(weight.tolist(), size.tolist(), allowed.tolist(), strict=True))
    if by_size:  # attractive before repulsive, then by id: of parallel edges the first in this order decides
        values = [(*x, k) for k, x in enumerate(values)]
        key = lambda x: (-abs(x[0]), x[0] <= 0 or not x[2], x[3])
        folds[linkage] = lambda a, b: min(a, b, key=key)
    else:
        key = lambda x: -x[0]
    graph = Contraction(n, u, v, values, folds[linkage])
    heap = [(key(x), a, b, x) for a in range(n) for b, x in graph.links[a].items() if a < b]
    heapq.heapify(heap)
    enemies: list[set[int]] = [set() for _ in range(n)]
    left = n
    while heap and left > num_clusters_stop:
        _, a, b, x = heapq.heappop(heap)
        if graph.links[a].get(b) != x or b in enemies[a]:
            continue
        if x[0] <= 0 and not by_size:
            break
        if x[0] <= 0 or not x[2]:
            enemies[a].add(b)
            enemies[b].add(a)
            continue
        root, changed = graph.merge(a, b)
        gone = b if root == a else a
        left -= 1
        for c in enemies[gone]:
            enemies[c].discard(gone)
            enemies[c].add(root)
        enemies[root] |= enemies[gone]
        enemies[gone] = set()
        for c in changed:
            y = graph.links[root][c]
            if c not in enemies[root]:
                heapq.heappush(heap, (key(y), min(root, c), max(root, c), y))
    return graph.sets.labels()


def agglomerate(n, u, v, indicator, edge_size, node_size, num_clusters_stop: int = 1, size_regularizer: float = 1.0, features=None, beta: float = 0.5) -> np.ndarray:
    """Merge the edge of least priority: its size-weighted mean indicator times the harmonic size factor
    2 / (1 / su^r + 1 / sv^r); with node features, a blend of indicator and feature distance, (1 - beta) and beta."""
    sizes = np.asarray(node_size, dtype=float).tolist()
    feats = None if features is None else [np.asarray(f, dtype=float) for f in features]
    fold = lambda a, b: ((a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1])
    graph = Contraction(n, u, v, list(zip(indicator.tolist(), np.asarray(edge_size, float).tolist(), strict=True)), fold)

    def priority(a: int, b: int, x) -> float:
        factor = 2.0 / (1.0 / sizes[a] ** size_regularizer + 1.0 / sizes[b] ** size_regularizer)
        value = x[0] if feats is None else beta * float(np.linalg.norm(feats[a] - feats[b])) + (1 - beta) * x[0]
        return value * factor

    now: dict[tuple[int, int], float] = {}
    heap = []

    def push(a: int, b: int) -> None:
        key = (min(a, b), max(a, b))
        now[key] = priority(*key, graph.links[a][b])
        heapq.heappush(heap, (now[key], *key))

    for a in range(n):
        for b in graph.links[a]:
            if a < b:
                push(a, b)
    left = n
    while heap and left > num_clusters_stop:
        p, a, b = heapq.heappop(heap)
        if now.get((a, b)) != p or b not in graph.links[a]:
            continue
        root, _ = graph.merge(a, b)
        gone = b if root == a else a
        total = sizes[a] + sizes[b]
        if feats is not None:
            feats[root] = (feats[a] * sizes[a] + feats[b] * sizes[b]) / total
        sizes[root] = total
        left -= 1
        now.pop((a, b), None)
        for c in list(graph.links[root]):
            now.pop((min(gone, c), max(gone, c)), None)
            push(root, c)
    return graph.sets.labels()


class Histogram:
    """Mass over evenly placed values, the first at ``low``, the last at ``high``."""

    def __init__(self, bins: int, low: float, high: float):
        self.bins, self.low, self.high = bins, low, high

    def of(self, value: float) -> np.ndarray:
        """One unit at a value, shared by the two places around it."""
        out = np.zeros(self.bins)
        at = float(np.clip((value - self.low) / (self.high - self.low), 0.0, 1.0)) * (self.bins - 1)
        k = int(at)
        out[k] += 1 - (at - k)
        if at > k:
            out[k + 1] += at - k
        return out

    def median(self, mass: np.ndarray) -> float:
        """Where half of the mass is reached, linear within a bin. The bin's lower end is its predecessor's index plus half
        a bin's width in units of the value, as the published method has it."""
        upto = np.cumsum(mass)
        half = upto[-1] / 2
        k = int(np.searchsorted(upto, half))
        while k < self.bins - 1 and mass[k] == 0:
            k += 1
        if k == 0 or upto[-1] == 0:
            return self.low
        start = (k - 1) + (self.high - self.low) / self.bins / 2
        at = start + (half - (upto[k] - mass[k])) / mass[k]
        return self.low + at / (self.bins - 1) * (self.high - self.low)


def median_agglomeration(
    n, u, v, indicator, bins: int = 40, low: float = 0.0, high: float = 1.0, num_clusters_stop: int = 1, num_edges_stop: int = 0, threshold: float = 0.5
) -> np.ndarray:
    """Merge the edge of least priority while it is under ``threshold``: its indicator, and once edges were folded, the
    median of their indicators."""
    space = Histogram(bins, low, high)

    def fold(a, b):
        mass = a[1] + b[1]
        return (space.median(mass), mass)

    graph = Contraction(n, u, v, [(float(x), space.of(float(x))) for x in indicator], fold)
    heap = [(x[0], a, b) for a in range(n) for b, x in graph.links[a].items() if a < b]
    heapq.heapify(heap)
    left, edges = n, len(heap)
    while heap and left > num_clusters_stop and (not num_edges_stop or edges > num_edges_stop):
        p, a, b = heapq.heappop(heap)
        x = graph.links[a].get(b)
        if x is None or x[0] != p:
            continue
        if p >= threshold:
            break
        before = len(graph.links[a]) + len(graph.links[b]) - 2
        root, changed = graph.merge(a, b)
        left -= 1
        edges -= 1 + before - len(graph.links[root])
        for c in changed:
            heapq.heappush(heap, (graph.links[root][c][0], min(root, c), max(root, c)))
    return graph.sets.labels()


def affinity_watershed(n, u, v, level, seed) -> np.ndarray:
    """Claims by edge level, lowest first: a pixel takes the label of the first claim that is popped."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, x in zip(u.tolist(), v.tolist(), level.tolist(), strict=True):
        near[a].append((b, x))
        near[b].append((a, x))
    label = [int(x) for x in seed]
    heap = [(x, b, label[a]) for a in range(n) if label[a] for b, x in near[a] if not label[b]]
    heapq.heapify(heap)
    while heap:
        at, x, name = heapq.heappop(heap)
        if label[x]:
            continue
        label[x] = name
        for y, z in near[x]:
            if not label[y]:
                heapq.heappush(heap, (max(at, z), y, name))
    return np.array(label)


def edge_weighted_watershed(n, u, v, weight, seed) -> np.ndarray:
    """Kruskal from the seeds, lightest edge first (ties by id): a merge needs one side without a label; labels are kept."""
    sets = Clusters(n)
    label = [int(x) for x in seed]
    order = np.lexsort((np.arange(len(u)), weight))
    for a, b in zip(u[order].tolist(), v[order].tolist(), strict=True):
        a, b = sets.find(a), sets.find(b)
        if a != b and not (label[a] and label[b]):
            sets.up[b] = a
            label[a] = max(label[a], label[b])
    return np.array([label[x] for x in sets.labels().tolist()])


def minimum_spanning_forest(n, u, v, length) -> np.ndarray:
    """Whether each edge is in the forest, shortest first, ties by id."""
    sets = Clusters(n)
    keep = np.zeros(len(u), dtype=bool)
    for k in np.lexsort((np.arange(len(u)), length)).tolist():
        a, b = sets.find(int(u[k])), sets.find(int(v[k]))
        if a != b:
            sets.up[b] = a
            keep[k] = True
    return keep


def split_unconnected(n, u, v, label) -> np.ndarray:
    """Labels with each cluster cut into its pieces along the edges (u, v)."""
    sets = Clusters(n)
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        if label[a] == label[b]:
            a, b = sets.find(a), sets.find(b)
            if a != b:
                sets.up[max(a, b)] = min(a, b)
    return sets.labels()


def lifted_kernighan_lin(n, u, v, cost, is_lifted, outer: int | None = None, epsilon: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """Local search on base and lifted costs from ``start`` (the greedy result if none): single nodes move to the adjacent cluster, or a new
    one, and base-adjacent clusters join, as long as the energy falls (``outer`` rounds at most, if given). Clusters end connected by base edges."""
    base = ~is_lifted.astype(bool)
    label = lifted_greedy_additive(n, u, v, cost, is_lifted) if start is None else split_unconnected(n, u[base], v[base], np.asarray(start))
    best, low = label, energy(u, v, cost, label)
    links: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
    for a, b, x, z in zip(u.tolist(), v.tolist(), cost.tolist(), base.tolist(), strict=True):
        links[a].append((b, x, z))
        links[b].append((a, x, z))
    for _ in itertools.count() if outer is None else range(outer):  # the energy falls by more than epsilon with each round
        now = label.tolist()
        fresh = n + 1
        for x in range(n):
            pull: dict[int, float] = {}
            beside = set()
            for y, w, z in links[x]:
                pull[now[y]] = pull.get(now[y], 0.0) + w
                if z:
                    beside.add(now[y])
            own = pull.get(now[x], 0.0)
            options = [(pull.get(c, 0.0) - own, -c) for c in beside if c != now[x]] + [(-own, -fresh)]
            gain, c = max(options)
            if gain > epsilon:
                now[x] = -c
                fresh += -c == fresh
        label = split_unconnected(n, u[base], v[base], now)
        between: dict[tuple[int, int], list] = {}
        for a, b, w, z in zip(label[u].tolist(), label[v].tolist(), cost.tolist(), base.tolist(), strict=True):
            if a != b:
                entry = between.setdefault((min(a, b), max(a, b)), [0.0, False])
                entry[0] += w
                entry[1] |= z
        pairs = [(a, b, x[0]) for (a, b), x in between.items() if x[1] and x[0] > epsilon]
        to: dict[int, int] = {}
        for a, b, _ in sorted(pairs, key=lambda p: -p[2]):  # disjoint pairs: the sums of others may change with a pair
            if a not in to and b not in to:
                to[a] = to[b] = a
        label = np.array([to.get(x, x) for x in label.tolist()], dtype=label.dtype)
        e = energy(u, v, cost, label)
        if e >= low - epsilon:
            break
        best, low = label, e
    return best


def without_ticks(n, u, v, length, tick_length: float) -> np.ndarray:
    """Whether each edge stays when the shortest branch between an end and a junction, if under ``tick_length``, is taken
    away again and again. A junction left with two branches is one no more: they are measured as one. Paths between two
    ends stay."""
    keep = np.ones(len(u), dtype=bool)
    links: list[dict[int, int]] = [{} for _ in range(n)]
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        links[a][k], links[b][k] = b, a

    def branch(leaf: int) -> tuple[float, list[int]] | None:
        """From an end to the next junction: its length and edges; None if it leads to another end."""
        total, used, at, last = 0.0, [], leaf, -1
        while True:
            (edge,) = (k for k in links[at] if k != last)
            used.append(edge)
            total += float(length[edge])
            at, last = links[at][edge], edge
            if len(links[at]) == 1:
                return None
            if len(links[at]) > 2:
                return total, used

    heap = []

    def offer(leaf: int) -> None:
        found = branch(leaf)
        if found is not None and found[0] < tick_length:
            heapq.heappush(heap, (found[0], leaf, found[1]))

    for x in range(n):
        if len(links[x]) == 1:
            offer(x)
    while heap:
        total, leaf, used = heapq.heappop(heap)
        if len(links[leaf]) != 1:
            continue
        now = branch(leaf)
        if now is None:
            continue
        if now != (total, used):  # it has grown since: its junction is none any more
            offer(leaf)
            continue
        for k in used:
            keep[k] = False
            del links[int(u[k])][k], links[int(v[k])][k]
    return keep
