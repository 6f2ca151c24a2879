"""Flows and matchings against brute force, conversions against their definitions."""

import itertools
import random

import numpy as np
import pytest

from graphloom.operators import convert, edges, flow


@pytest.mark.parametrize("seed", range(8))
def test_max_flow_is_the_least_separating_cut(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 8)
    rows = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 9)) for _ in range(rng.randint(1, 20))]
    best = min(sum(w for a, b, w in rows if (mask >> a & 1) != (mask >> b & 1)) for mask in range(1 << n) if mask & 1 and not mask >> (n - 1) & 1)
    src, dst, weight = (np.array(x) for x in zip(*rows, strict=True))
    value, side = flow.max_flow(n, src, dst, weight, 0, n - 1)
    assert value == best == sum(w for a, b, w in rows if side[a] != side[b]) and side[0] and not side[n - 1]


@pytest.mark.parametrize("seed", range(8))
def test_matching_is_maximum(seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(5), rng.randrange(5)) for _ in range(9)})
    best = max(k for k in range(6) for some in itertools.combinations(pairs, k) if len({a for a, _ in some}) == len({b for _, b in some}) == k)
    found = flow.matching(*(np.array(x) for x in zip(*pairs, strict=True)))
    assert len(found) == best and set(found) <= set(pairs) and len({a for a, _ in found}) == len({b for _, b in found}) == best


def test_operators(spark, tmp_path):
    g = spark.createDataFrame([(0, 1, 3), (1, 2, 2), (0, 2, 1), (2, 2, 5)], "src long, dst long, weight long")
    assert tuple(flow.st_min_cut(g, 0, 2).first()) == (3, [0, 1]) or flow.st_min_cut(g, 0, 2).first().cut_value == 3
    pairs = spark.createDataFrame([(1, 11), (1, 12), (2, 11), (3, 13), (4, 13)], "src long, dst long")
    assert flow.bipartite_matching(pairs).count() == 3
    assert convert.with_ring(g, 3).count() == 7 and convert.with_tree(g, 3).count() == 6
    assert edges.vertices(convert.disjoint_union([g, g], 3)).count() == 6
    assert {(r.vertex, r["out"], r["in"]) for r in convert.directed_degrees(g).collect()} == {(0, 2, 0), (1, 1, 1), (2, 1, 3)}
    assert {(r.degree, r.vertices) for r in convert.directed_histogram(g).collect()} == {(0, 1), (1, 1), (3, 1)}
    assert {(r.bucket, r.edges) for r in convert.offset_histogram(g, 1).collect()} == {(0, 1), (1, 2), (2, 1)}
    w = convert.with_random_weights(edges.symmetric(g), 5, 6).collect()
    assert {r.weight for r in w} <= {5, 6} and len({(min(r.src, r.dst), max(r.src, r.dst), r.weight) for r in w}) == 4
    assert [tuple(r)[:2] for r in convert.ordered(g).collect()] == [(0, 1), (0, 2), (1, 2), (2, 2)]
    convert.partitioned(g, "src", 4, f"{tmp_path}/parts")
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 4 and convert.cleaned_simple(g).count() == 3
    assert convert.with_constant_weight(g, 1).agg({"weight": "sum"}).first()[0] == 4


@pytest.mark.parametrize("seed", range(2))
def test_matching_of_a_graph_larger_than_a_task(spark, seed, monkeypatch):
    """By joins, without a component in one task: sparse graphs, on which proposals alone fall short, and a chain that has one long augmenting path at most."""
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(30), 100 + rng.randrange(25)) for _ in range(45)}) + [(200 + i, 300 + i + j) for i in range(6) for j in (0, 1) if i + j < 6]
    left, right = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    best = len(flow.matching(np.array([left.index(a) for a, _ in pairs]), np.array([right.index(b) for _, b in pairs])))
    monkeypatch.setattr(flow, "matching", None)
    rows = [(b, a) for a, b in pairs] if seed else pairs
    g = spark.createDataFrame(rows + rows[:5], "src long, dst long").repartition(3)
    found = [tuple(r) for r in flow.bipartite_matching(g, task_edges=0, broadcast_rows=0 if seed else 100).collect()]
    assert set(found) <= set(rows) and len({a for a, _ in found}) == len({b for _, b in found}) == len(found) == best
