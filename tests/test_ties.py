"""Solvers on graphs of few different weights, where ties and clusters in pieces are common; no task of Spark needed."""

import numpy as np
import pytest

from gridloom.operators import kernels


def graph(seed, n=40, m=110):
    rng = np.random.default_rng(seed)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b})
    u, v = (np.array(c) for c in zip(*pairs, strict=True))
    return n, u, v, rng.integers(-3, 4, len(u)).astype(float)


@pytest.mark.parametrize("seed", range(20))
def test_mutex_watershed_is_gasp_on_ties(seed):
    n, u, v, cost = graph(seed)
    a = kernels.mutex_watershed(n, u, v, np.abs(cost), cost <= 0)
    b = kernels.gasp(n, u, v, cost, linkage="mutex_watershed")
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("outer", [1, 100])
def test_local_search_ends_connected_and_final(seed, outer):
    n, u, v, cost = graph(seed)
    for start in (None, kernels.greedy_fixation(n, u, v, cost), np.zeros(n, dtype=int)):
        got = kernels.kernighan_lin(n, u, v, cost, outer=outer, start=start)
        assert len(np.unique(kernels.split_unconnected(n, u, v, got))) == len(np.unique(got))
        between = {}
        for a, b, x in zip(got[u].tolist(), got[v].tolist(), cost.tolist(), strict=True):
            if a != b:
                between[min(a, b), max(a, b)] = between.get((min(a, b), max(a, b)), 0.0) + x
        assert max(between.values(), default=0.0) <= 1e-6
        if start is not None:
            assert kernels.energy(u, v, cost, got) <= kernels.energy(u, v, cost, start) + 1e-9
