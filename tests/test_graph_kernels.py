"""Kernels and planning formulas against brute force and closed forms; no session needed."""

import math
import random

import numpy as np
import pytest

from graphloom.functions import theory
from graphloom.operators import kernels as K


def brute_cut(n, edges):
    best = None
    for mask in range(1, 1 << (n - 1)):
        value = sum(w for a, b, w in edges if (mask >> a & 1) != (mask >> b & 1))
        best = value if best is None else min(best, value)
    return best


def random_graph(rng, n, extra):
    edges = [(i, rng.randrange(i), rng.randint(1, 20)) for i in range(1, n)]
    return edges + [(rng.randrange(n), rng.randrange(n), rng.randint(1, 20)) for _ in range(extra)]


def arrays(edges):
    return tuple(np.array(x, np.int64) for x in zip(*edges, strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_stoer_wagner_and_trials_against_all_bipartitions(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 10)
    edges = random_graph(rng, n, rng.randint(0, 25))
    src, dst, weight = arrays(edges)
    want = brute_cut(n, edges)
    value, side = K.stoer_wagner(K.to_matrix(n, src, dst, weight))
    assert value == want and 0 < side.sum() < n
    assert sum(w for a, b, w in edges if side[a] != side[b]) == want
    value, side = K.forest_cut(n, src, dst, weight)
    assert value == want == sum(w for a, b, w in edges if side[a] != side[b]) and 0 < side.sum() < n
    best = min(K.cut_trial(n, *arrays([e for e in edges if e[0] != e[1]]), max(2, n // 2), t, base=4)[0] for t in range(60))
    assert best == want


def test_forest_cut_of_larger_graphs():
    rng = random.Random(1)
    for n in (2, 40, 90):
        edges = random_graph(rng, n, 4 * n)
        src, dst, weight = arrays(edges)
        value, side = K.forest_cut(n, src, dst, weight)
        assert value == K.stoer_wagner(K.to_matrix(n, src, dst, weight))[0] == sum(w for a, b, w in edges if side[a] != side[b])


def test_recursive_contraction_of_a_graph_above_the_base_case():
    rng = random.Random(7)
    edges = [(i, j, 50) for part in (range(70), range(70, 140)) for i in part for j in part if i < j and rng.random() < 0.3] + [(3, 90, 7), (5, 120, 8)]
    edges += [(i, i + 1, 50) for i in range(69)] + [(i, i + 1, 50) for i in range(70, 139)]
    m = K.to_matrix(140, *arrays(edges))
    assert K.stoer_wagner(m)[0] == 15
    assert K.karger_stein(m, 0.95, 1)[0] == 15
    assert min(K.recursive_cut_once(m, np.random.default_rng(t))[0] for t in range(8)) == 15


def test_shuffled_weights_and_loops_change_nothing():
    rng = random.Random(3)
    edges = random_graph(rng, 9, 20)
    value = K.stoer_wagner(K.to_matrix(9, *arrays(edges)))[0]
    names = list(range(9))
    rng.shuffle(names)
    moved = [(names[a], names[b], w) for a, b, w in edges] + [(4, 4, 100)]
    assert K.stoer_wagner(K.to_matrix(9, *arrays(moved)))[0] == value
    assert K.stoer_wagner(K.to_matrix(9, *arrays([(a, b, 3 * w) for a, b, w in edges])))[0] == 3 * value
    split = [x for a, b, w in edges for x in ((a, b, w - w // 2), (b, a, w // 2))]
    assert K.stoer_wagner(K.to_matrix(9, *arrays(split)))[0] == value


@pytest.mark.parametrize("seed", range(6))
def test_components_and_prefixes(seed):
    rng = random.Random(seed)
    n, edges = 30, [(rng.randrange(30), rng.randrange(30)) for _ in range(25)]
    src, dst = arrays(edges)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    left, counts = n, []
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            left -= 1
        counts.append(left)
    assert K.component_labels(n, src, dst).tolist() == [find(i) for i in range(n)]
    for k in (28, left):
        used, labels = K.prefix_components(n, src, dst, k)
        assert counts[used - 1] <= k and (used == 1 or counts[used - 2] > k) and len(set(labels.tolist())) == counts[used - 1]
    assert K.prefix_components(n, src, dst, 1)[0] == (len(edges) if left > 1 else counts.index(1) + 1)


def test_planning_formulas():
    assert theory.contraction_target(100) == 128 and theory.contraction_target(1000) == math.ceil(1000 / math.sqrt(2)) + 1
    assert theory.recursion_depth(128) == 0 and theory.success_of_recursion(128) == 1.0 and theory.success_of_recursion(129) == 0.75
    # published runs: a graph of 96,000 vertices and 1,536,000 edges takes 16,176 trials at 0.95
    assert theory.cut_trials(96_000, 1_536_000, 0.95) == 16_176
    assert theory.approximate_trials(0.9) == 4 and theory.approximate_trials(0.95) == 5
    assert theory.recursion_trials(100, 0.9) == 1 and theory.recursion_trials(5000, 0.0) == 1
    p = theory.success_of_recursion(5000)
    t = theory.recursion_trials(5000, 0.9)
    assert (1 - p) ** t <= 0.1 < (1 - p) ** (t - 1)
    assert theory.concurrency(7, 4) == "low" and theory.concurrency(8, 4) == "high"


def test_matrix_contraction():
    m = K.to_matrix(4, *arrays([(0, 1, 2), (1, 2, 3), (2, 3, 4), (0, 3, 5), (1, 1, 9)]))
    out = K.contract_matrix(m, np.array([0, 0, 1, 1]))
    assert out.tolist() == [[0, 8], [8, 0]]


def test_exact_cut_of_heavy_weights_takes_no_longer():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 400, 40_000), rng.integers(0, 400, 40_000)
    w = rng.integers(2**40, 2**41, 40_000)
    value, side = K.forest_cut(400, a, b, w)
    assert value == w[side[a] != side[b]].sum() and value < 2**63


def test_shares_of_trials_by_memory():
    assert theory.trial_shares(10, [8, 16, 3], 4) == [4, 6, 0]
    assert theory.trial_shares(3, [100, 100, 100], 4) == [1, 1, 1]
    assert sum(theory.trial_shares(1001, [7, 9, 30], 3)) == 1001
    with pytest.raises(ValueError):
        theory.trial_shares(1, [2], 3)


@pytest.mark.parametrize("seed", range(6))
def test_inseparable_vertices_are_not_cut_below_the_bound(seed):
    rng = np.random.default_rng(seed)
    n, m = 9, 30
    src, dst, weight = rng.integers(n, size=m), rng.integers(n, size=m), rng.integers(1, 4, size=m)
    for bound in (1, 5, 9):
        found = K.inseparable(n, src, dst, weight, bound, most_classes=4)
        for mask in range(1, 1 << (n - 1)):
            side = mask >> np.arange(n) & 1
            if weight[side[src] != side[dst]].sum() < bound:
                assert (side == side[found]).all()
    assert (K.inseparable(n, src, dst, weight, 1) == K.component_labels(n, src, dst)).all()
