"""Near-duplicate vectors against brute force: exact on separated groups, recall and precision on hard data."""

import numpy as np
import pytest

from graphloom.llm import flatgraph
from graphloom.llm.flatgraph import near_duplicates


def brute(rows, threshold):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, good, strict=True)]
    links = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        stack, group = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in group:
                    group.add(j)
                    stack.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=str)


def corpus(seed, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(120):
        base = rng.normal(size=16)
        for _ in range(rng.choice([1, 1, 1, 2, 5, 40]) if g else 150):
            rows.append([float(np.float32(x)) for x in (base + rng.normal(size=16) * noise) * rng.choice([1, 5])])
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    rows += [(5000 + i, rows[3][1]) for i in range(30)] + [(7, rows[9][1]), (None, rows[9][1]), (None, [0.5] * 15 + [-9.0])]
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [None] + [1.0] * 15), (6003, [float("nan")] * 16), (6004, []), (6005, [1.0, 2.0]), (6006, [2.0, 4.0]), (6007, [float("inf")] + [1.0] * 15)]
    return rows


@pytest.mark.parametrize("seed,cell,part", [(1, 2048, 4096), (2, 60, 50)])
def test_separated_groups_are_found_exactly(spark, monkeypatch, seed, cell, part):
    monkeypatch.setattr(flatgraph, "CELL", cell)
    monkeypatch.setattr(flatgraph, "PART", part)
    rows = corpus(seed, 0.03)
    df = spark.createDataFrame([(v, i, True) for i, v in rows], "embedding array<float>, vec_id long, kept boolean").repartition(3)
    got = sorted((tuple(r) for r in near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows, 0.95)


def test_recall_and_precision_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "CELL", 60)
    rows = corpus(3, 0.22)
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    real = brute(rows, 0.95)
    assert sum(r[1] for r in got) <= sum(r[1] for r in real) and sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in real)


def test_a_pair_counts_on_both_sides_whichever_search_finds_it(spark, monkeypatch):
    """The search of every second vector finds nothing: its links are those that the others' searches found."""
    rows = corpus(4, 0.03)
    real, unit = flatgraph.range_search, lambda v: np.asarray(v, np.float64) / np.linalg.norm(v)
    firsts = {}
    for _, v in rows:
        if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v):
            firsts.setdefault(round(float(unit(v)[0]), 4), len(firsts) % 2)
    blind = lambda x, graph, query, starts, least: [] if firsts.get(round(float(query[0]), 4), 0) and len(query) == 16 else real(x, graph, query, starts, least)
    nodes = spark.createDataFrame([(i, unit(v).tobytes(), 1) for i, (_, v) in enumerate(rows[:300])], "node long, x binary, n long")
    work = flatgraph.Workspace(spark, "blind")
    index = flatgraph._Index(work.write(nodes, "nodes"), 16, work, 2, 4, 0)
    monkeypatch.setattr(flatgraph, "range_search", blind)
    # the workers' functions are called here, on a part's rows
    part = index.members.join(index.united, "node", "left").select("node", "x", "n", flatgraph.F.coalesce("near", flatgraph.F.array().cast("array<long>")).alias("near")).orderBy("node").toArrow()
    state = flatgraph._opened(part, 16)
    found = [b.to_pylist() for batch in part.select(["node", "x", "n"]).to_batches() for b in flatgraph._answered(state, batch, 16, 0.95)]
    found = spark.createDataFrame([tuple(r.values()) for b in found for r in b], "a long, b long, na long, nb long")
    got = {r.node: (r.found, r.partners) for r in flatgraph.link_counts(found).collect()}
    x = np.array([unit(v) for _, v in rows[:300]])
    sees = np.array([not firsts.get(round(float(v[0]), 4), 0) for v in x])
    links = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool) & (sees[:, None] | sees[None, :])
    assert 0 < sees.sum() < len(x) and got == {i: (int(k), int(k)) for i, k in enumerate(links.sum(axis=1)) if k}


def test_audit_is_by_node_and_blind_to_what_was_found(spark):
    """A group with all its links, in many copies, does not outweigh pairs that lost theirs."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.repeat(base, 2, axis=0) + rng.normal(size=(120, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, v.tobytes(), 1_000_000 if i < 2 else 1) for i, v in enumerate(x)], "node long, x binary, n long")
    counts = spark.createDataFrame([(0, 1_000_000, 1), (1, 1_000_000, 1)], "node long, found long, partners long")
    assert flatgraph.audit(nodes, counts, 16, 0.95) < 0.1
    assert flatgraph.audit(nodes, spark.createDataFrame([(i, 1, 1) for i in range(120)], counts.schema), 16, 0.95) == 1.0


def test_all_pairs_are_tried_where_the_audit_stays_short(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "CELL", 200)
    monkeypatch.setattr(flatgraph, "PART", 50)
    monkeypatch.setattr(flatgraph, "audit", lambda *_: 0.0)
    rows = corpus(3, 0.22)
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert got == brute(rows, 0.95)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert near_duplicates(df.limit(0)).collect() == []
