"""Top-k by M-trees against all inner products."""

import numpy as np
import pytest

from graphloom.llm import mtree
from graphloom.llm.mtree import top_inner_products


def brute(rows, k, every):
    width = max((len(v) for _, v in rows if v), default=0)
    good = [(i, key, np.array([np.floor(64 * float(x)) for x in v] + [0.0] * (width - len(v)))) for i, (key, v) in enumerate(rows) if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, key, q in good:
        if key % every == 0:
            found = sorted(((-int(q @ x), other) for j, other, x in good if j != i))[:k]
            out += [(key, r + 1, other, -s) for r, (s, other) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed,part,page", [(1, 8192, 512), (2, 60, 16), (3, 40, 7)])
def test_against_brute_force(spark, monkeypatch, seed, part, page):
    monkeypatch.setattr(mtree, "PART", part)
    monkeypatch.setattr(mtree.build, "__defaults__", (None, page, 4))
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([0.01, 1, 3])]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(90)] + [(7, rows[7][1]), (20, rows[3][1]), (20, rows[20][1])]
    rows += [(400, None), (420, [None] * 6), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (480, []), (500, [1.0, 2.0]), (None, [1.0] * 6), (520, [0.0] * 6)]
    df = spark.createDataFrame([(v, 1, key) for key, v in rows], "embedding array<float>, score int, vec_id long").repartition(3)
    got = sorted(tuple(r) for r in top_inner_products(df, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 5, 20)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_inner_products(df).collect()] == [(0, 1, 1, 64 * 128)]
    assert top_inner_products(df.limit(0)).collect() == []


def brute_integers(rows, k, every):
    good = [(i, key, [int(np.floor(64 * x)) for x in v]) for i, (key, v) in enumerate(rows)]
    out = []
    for i, key, q in good:
        if key % every == 0:
            products = [(sum(a * b for a, b in zip(q, x, strict=True)), other) for j, other, x in good if j != i]
            found = sorted((-max(min(p, 2**63 - 1), 1 - 2**63), other) for p, other in products)[:k]
            out += [(key, r + 1, other, -s) for r, (s, other) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("size", [5e6, 3e7, 1e9, 1e30])
def test_products_beyond_double_precision(spark, monkeypatch, size):
    """Products from 2**53 on, and beyond a long, where single units decide ranks."""
    monkeypatch.setattr(mtree, "PART", 50)
    monkeypatch.setattr(mtree.build, "__defaults__", (None, 9, 4))
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 4)) * size
    rows = [(i, (base[i % 20] + rng.integers(-3, 4, size=4) / 64).tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_inner_products(df, 5).collect())
    assert got == brute_integers(rows, 5, 20)
    assert size > 1e8 or max(s for *_, s in got) > 2**53
