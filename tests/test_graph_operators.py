"""Graph operators on a session: golden graphs, brute force, metamorphic checks, files and converters."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import rand, stats, theory
from graphloom.operators import connectivity, edges, matrix, mincut, traversal
from graphloom.operators.components import connected_components
from graphloom.plans import queries as plans
from graphloom.sources import generators, graph_io

from .test_graph_kernels import brute_cut, random_graph

DATA = "/root/testdata/sf0.001"
#: Small graphs with known components and cuts: name, vertices, edges, components, cut, side.
GOLDEN = [
    ("cc_8", 8, [(0, 1, 1), (1, 3, 1), (2, 4, 1)], 5, 0, None),
    ("cc_13", 13, [(0, 1, 1), (1, 7, 1), (2, 4, 1), (11, 12, 1), (10, 11, 1), (9, 12, 1), (9, 10, 1), (3, 9, 1), (1, 11, 1)], 5, 0, None),
    ("complete_4", 4, [(0, 1, 100), (0, 2, 57), (0, 3, 15), (1, 2, 1), (1, 3, 12), (2, 3, 75)], 1, 85, [0, 1]),
    ("cycle_10", 10, [(0, 1, 10000), (0, 3, 10000), (1, 2, 10000), (2, 3, 10000), (3, 4, 10000), (4, 5, 10000), (5, 6, 10), (6, 7, 10000), (7, 8, 10000), (8, 9, 10000)], 1, 10, [6, 7, 8, 9]),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight long")


@pytest.mark.parametrize("name,n,rows,components,cut,side", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(spark, name, n, rows, components, cut, side):
    g, everyone = frame(spark, rows), spark.range(n).toDF("vertex")
    labelled = connectivity.labels(g, everyone)
    assert connectivity.component_count(labelled).first()[0] == components
    got = mincut.minimum_cut(g, everyone).first()
    assert got.cut_value == cut and (side is None or got.side == side)
    if cut:
        assert mincut.minimum_cut(g, exact_vertices=1, prune=False).first().cut_value == cut
        assert mincut.minimum_cut(g, exact_vertices=1, prune=False, broadcast_edges=0).first().cut_value == cut
    assert tuple(mincut.minimum_cut(g, everyone, sides=False).first())[:2] == (cut, None)
    near = mincut.approximate_cut(g, everyone).first()
    assert near.found and (near.weight == 0) == (cut == 0)


@pytest.mark.parametrize("seed", range(3))
def test_minimum_cut_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(6, 10)
    rows = random_graph(rng, n, 20)
    want = brute_cut(n, rows)
    for pruned in (True, False):
        got = mincut.minimum_cut(frame(spark, rows), prune=pruned).first()
        assert got.cut_value == want and sum(w for a, b, w in rows if (a in got.side) != (b in got.side)) == want


def test_cut_of_degenerate_graphs(spark):
    empty = frame(spark, [])
    assert mincut.minimum_cut(empty).first().cut_value is None
    assert mincut.minimum_cut(frame(spark, [(1, 1, 5)])).first().cut_value is None
    assert mincut.minimum_cut(frame(spark, [(1, 2, 0)])).first().cut_value == 0


def test_sampled_components_equal_star_contraction(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.randrange(400), 1) for _ in range(380)]
    g = frame(spark, rows)
    want = dict(connected_components(g).collect())
    for size in (20, 1_000_000):
        assert dict(connectivity.sampled_components(g, seed=4, sample_edges=size).collect()) == want
    again = frame(spark, [(b, a, 3) for a, b, _ in rows + rows])
    assert dict(connected_components(again.repartition(7)).collect()) == want


def test_components_in_one_task_equal_the_rounds(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(90), rng.randrange(90), 1) for _ in range(70)] + [(95, 95, 1)]
    g = frame(spark, rows)
    small = connected_components(g, kernel_edges=1000)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, connected_components(g).collect()))
    assert connected_components(g.limit(0), kernel_edges=10).collect() == []


def test_repair_connects(spark):
    g = frame(spark, [(0, 1, 1), (1, 2, 1), (5, 6, 1), (7, 7, 1)])
    fixed = connectivity.repaired(g, connected_components(g)).collect()
    assert sorted((r.src, r.dst, r.weight) for r in fixed)[:2] == [(0, 1, 1), (1, 2, 1)] and sum(r.weight == 5000 and r.dst in (0, 1, 2) for r in fixed) == 3


def test_randomness_does_not_depend_on_partitions(spark):
    a = {r[0]: r[1] for r in spark.range(0, 500, 1, 2).select("id", rand.uniform(1, "id")).collect()}
    b = {r[0]: r[1] for r in spark.range(0, 500, 1, 7).select("id", rand.uniform(1, "id")).collect()}
    assert a == b and all(0 <= x < 1 for x in a.values())
    kept = spark.range(20000).filter(rand.survives(F.lit(5), F.lit(3), 2, "id")).count() / 20000
    assert abs(kept - (1 - (7 / 8) ** 5)) < 0.02


def test_edge_list_round_trip_and_checks(spark, tmp_path):
    g = frame(spark, [(0, 1, 3), (2, 1, 4), (2, 2, 9)])
    graph_io.write_edge_list(g, f"{tmp_path}/g", 3)
    back, n, m = graph_io.read_edge_list(spark, f"{tmp_path}/g")
    assert (n, m) == (3, 3) and sorted(map(tuple, back.collect())) == [(0, 1, 3), (2, 1, 4), (2, 2, 9)]
    (tmp_path / "bad").write_text("# x\n2 2\n0 1 1\n1 2 1")
    with pytest.raises(ValueError):
        graph_io.read_edge_list(spark, f"{tmp_path}/bad")
    (tmp_path / "plain").write_text("anything\n# more\n3 2\n0 1\n\n1 2 7")
    back, n, m = graph_io.read_edge_list(spark, f"{tmp_path}/plain")
    assert sorted(map(tuple, back.collect())) == [(0, 1, 1), (1, 2, 7)]
    (tmp_path / "snap").write_text("# c\n10\t7\n7\t7\n99999999999999999999\t10\n")
    assert sorted(map(tuple, graph_io.read_snap(spark, f"{tmp_path}/snap").select("src", "dst", "weight").collect())) == [(0, 1, 1), (2, 0, 1)]
    (tmp_path / "dimacs").write_text("c x\np max 3 1\na 1 2 5\n")
    assert list(map(tuple, graph_io.read_rebased(spark, f"{tmp_path}/dimacs").collect())) == [(0, 1, 5)]


def test_logs_and_results(spark, tmp_path):
    (tmp_path / "a.out").write_text("srun x\n/in/a,1,2\nPAPI,1,5\nPAPI,3,4\n/in/b,1,2\n")
    rows = graph_io.harvest(spark, f"{tmp_path}/*.out", 2).orderBy("line").collect()
    assert [(r.line, r.c0, r.c1) for r in rows] == [("/in/a,1,2", 3.0, 5.0), ("/in/b,1,2", None, None)]
    row = spark.createDataFrame([("g", 1, 4, 10, 20, 0.5, "?", "low", 7)], graph_io.RESULT)
    row.write.option("header", True).csv(f"{tmp_path}/results")
    assert graph_io.read_results(spark, f"{tmp_path}/results").collect() == row.collect()
    graph_io.write_adjacency(frame(spark, [(0, 1, 2)]), f"{tmp_path}/rows")
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2


def test_generators_have_the_shapes_they_are_named_for(spark):
    size = lambda g: (g.count(), edges.vertices(g).count())
    assert size(generators.complete(spark, 20)) == (190, 20) and size(generators.barbell(spark, 4, 2)) == (15, 10)
    assert size(generators.caveman(spark, 3, 4)) == (18, 12) and size(generators.lollipop(spark, 4, 3)) == (9, 7)
    assert set(r.degree for r in edges.degrees(generators.random_regular(spark, 50, 6)).collect()) == {6}
    assert generators.rmat(spark, 64, 500).filter("src = dst or src >= 64 or dst >= 64").isEmpty()
    assert generators.erdos_renyi(spark, 10, 0.0).count() == 0 and generators.erdos_renyi(spark, 10, 1.0).count() == 45
    similar = generators.clustered_similarity(spark, 80).withColumn("mate", F.col("src") % 10 == F.col("dst") % 10).groupBy("mate").agg(F.avg("weight").alias("w"), F.min("weight").alias("low")).collect()
    mean = {r.mate: r.w for r in similar}
    assert mean[True] > mean[False] + 2 and all(r.low >= 0 for r in similar)
    assert set(generators.verification_suite(spark, 200)) >= {"barbell", "wheel"} and len(generators.density_suite(spark, 20, (2, 4))) == 2
    assert len(generators.rmat_suite(spark, [(16, 2)])) == 1


def test_prefix_sums_and_ranks_over_many_ranges(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r.offset for r in edges.prefix_sums(df, "k", "v", exclusive=False, shards=9).collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want
    assert [r.new for r in edges.ranked(df, ["k"], shards=5).orderBy("k").collect()] == list(range(101))
    assert edges.prefix_sums(df.limit(0), "k", "v").count() == 0


def test_matrices(spark):
    g = frame(spark, [(0, 1, 2), (1, 0, 3), (1, 2, 4), (2, 2, 9)])
    m = matrix.from_edges(g)
    assert sorted(map(tuple, m.collect())) == [(0, 1, 5), (1, 0, 5), (1, 2, 4), (2, 1, 4)]
    assert matrix.is_symmetric(m).first()[0] and not matrix.is_symmetric(m.filter("row < col")).first()[0]
    rows = {r.row: r["values"] for r in matrix.to_rows(m, 3).collect()}
    assert rows[1] == [5, 0, 4]
    assert sorted(map(tuple, matrix.from_rows(matrix.to_rows(m, 3)).collect())) == sorted(map(tuple, m.collect()))
    assert matrix.total(m).first()[0] == 18 and matrix.row(m, 1).count() == 2


def test_traversals_on_small_graphs(spark):
    g = frame(spark, [(0, 1, 7), (1, 2, 1), (0, 2, 3), (3, 4, 1)])
    assert {r.vertex: r.level for r in traversal.bfs_levels(g, [0]).collect()} == {0: 0, 1: 1, 2: 1}
    assert {r.vertex: r.distance for r in traversal.shortest_paths(g, [0]).collect()} == {0: 0, 1: 4, 2: 3}
    assert sorted(map(tuple, traversal.spanning_forest(g).collect())) == [(0, 2, 3), (1, 2, 1), (3, 4, 1)]
    ring = generators.cycle(spark, 6)
    assert {round(r["rank"], 6) for r in traversal.pagerank(ring, 30, tolerance=1e-9).collect()} == {1.0}
    assert traversal.independent_set(g).count() == 2
    assert {r.side for r in traversal.bisection(g, 3).collect()} == {0, 1}


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 1.0), ("b", 2.0)], "g string, t double")
    got = {r.g: r for r in stats.median_interval(df, ["g"], "t").collect()}
    # 20 values: ranks floor((20 - 1.96 sqrt 20) / 2) = 5 and floor(1 + (20 + 1.96 sqrt 20) / 2) = 15
    assert (got["a"].median, got["a"].ci_lo, got["a"].ci_hi) == (10.5, 5.0, 15.0)
    assert (got["b"].median, got["b"].ci_lo) == (1.5, None)
    assert stats.trend(spark.createDataFrame([(1.0, 3.0), (2.0, 5.0)], "x double, y double"), "x", "y").first() == (2.0, 1.0)


def planted(rng, n, bridges):
    """Two dense clusters of n vertices and so many edges of weight 1 between them."""
    rows = [(c * n + i, c * n + j, rng.randint(5, 9)) for c in range(2) for i in range(n) for j in range(i) if rng.random() < 0.3]
    return rows + [(i, n + i, 1) for i in range(bridges)]


def test_shrinking_branching_trials_find_the_planted_side(spark):
    rows = planted(random.Random(2), 160, 7)
    for options in ({"broadcast_edges": 0, "task_vertices": 150}, {"broadcast_edges": 0}, {}):
        for prune in (False, True):
            got = mincut.minimum_cut(frame(spark, rows), exact_vertices=1, prune=prune, max_trials=2, **options).first()
            assert (got.cut_value, got.side, got.variant) == (7, list(range(160)), "high" if options else "low"), options


def test_small_world_cut_against_flows(spark):
    """The exact cut is the least of the cuts between one vertex and each other."""
    from graphloom.operators.flow import max_flow

    import numpy as np

    g = generators.small_world(spark, 60, 6, 0.3, seed=4)
    rows = [tuple(r) for r in g.collect()]
    names = sorted({v for a, b, _ in rows for v in (a, b)})
    at = {v: i for i, v in enumerate(names)}
    a, b, w = (np.array(x) for x in zip(*((at[x], at[y], z) for x, y, z in rows), strict=True))
    want = min(max_flow(len(names), a, b, w, 0, t)[0] for t in range(1, len(names)))
    assert mincut.minimum_cut(g).first().cut_value == want


def test_components_by_weight_and_by_parts(spark):
    rng = random.Random(6)
    rows = random_graph(rng, 300, 240)
    g = frame(spark, rows)
    want = sorted(tuple(r) for r in connected_components(g).collect())
    assert sorted(tuple(r) for r in connectivity.sampled_components(g, sample_edges=40, weight="weight").collect()) == want
    for parts in (1, 3):
        assert sorted(tuple(r) for r in connectivity.divided_components(g, parts, kernel_edges=0).collect()) == want
    assert connectivity.divided_components(g.limit(0)).collect() == []


def test_draws_with_replacement(spark):
    from graphloom.operators import sampling

    g = frame(spark, [(0, 1, 1), (1, 2, 0), (2, 3, 97), (3, 4, 2), (3, 4, 2), (5, 5, -4)])
    drawn = sampling.with_replacement(g, 4000, 3, "weight", shards=3).collect()
    assert sorted(r.draw for r in drawn) == list(range(4000))
    count = lambda *edge: sum(tuple(r)[1:] == edge for r in drawn)
    assert count(1, 2, 0) == count(5, 5, -4) == 0 and 3700 < count(2, 3, 97) < 3900 and 100 < count(3, 4, 2) < 220
    again = sampling.with_replacement(g.repartition(5), 4000, 3, "weight", shards=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    even = sampling.with_replacement(g, 6000, 4).groupBy("src").count().collect()
    assert all(800 < r["count"] < 1200 or r["src"] == 3 and 1700 < r["count"] < 2300 for r in even)
    assert sampling.with_replacement(g.limit(0), 5, 1).collect() == []


def test_kway_partition_keeps_its_bound(spark):
    rows = [(c * 20 + i, c * 20 + j, 5) for c in range(4) for i in range(20) for j in range(i)] + [(20 * c, (20 * c + 20) % 80, 1) for c in range(4)]
    parts = {r.vertex: r.part for r in traversal.kway_partition(frame(spark, rows), 4, 0.1, rounds=12).collect()}
    sizes = [list(parts.values()).count(p) for p in range(4)]
    assert len(parts) == 80 and max(sizes) <= 22
    start = {r.vertex: r.part for r in traversal.kway_partition(frame(spark, rows), 4, 0.1, rounds=0).collect()}
    cut = lambda of: sum(w for a, b, w in rows if of[a] != of[b])
    assert cut(parts) < cut(start) and traversal.kway_partition(frame(spark, []), 4).collect() == []


def test_edge_list_folders_follow_their_names_and_headers_come_late(spark, tmp_path):
    """The header's file is the smallest, a hundred comments stand before it, and the other files are read whole."""
    folder = tmp_path / "graph"
    folder.mkdir()
    (folder / "part-00000").write_text("a free line\n" + "# more\n" * 100 + "5000 4000\n0 1 2\n")
    for i, size in ((1, 3000), (2, 999)):
        (folder / f"part-0000{i}").write_text("".join(f"{j} {j + 1}\n" for j in range(size)))
    edges, n, m = graph_io.read_edge_list(spark, str(folder))
    assert (n, m, edges.count(), edges.agg({"weight": "sum"}).first()[0]) == (5000, 4000, 4000, 4001)


def test_queries_of_files_and_slices_equal_their_sql(spark):
    con = duckdb.connect()
    for name in ("orders", "customer", "supplier", "nation", "lineitem"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for name in ("edge_list_round_trip", "snap_file_counts", "adjacency_file", "logs_harvested", "prefix_sums_inclusive", "edge_slice", "recursion_plan"):
        rows = plans.QUERIES[name](spark, DATA)
        found = con.execute(plans.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(tuple(r) for r in rows.select(*columns).collect()) == sorted(found.fetchall()), name


def test_exact_cut_of_a_graph_larger_than_a_task(spark, monkeypatch):
    """Tasks contract what their edges prove inseparable, and what is left is solved exactly, without trials."""
    from graphloom.operators import mincut
    from graphloom.plans import graphs

    monkeypatch.setattr(mincut, "EXACT_EDGES", 1000)
    monkeypatch.setattr(mincut, "LOCAL_EDGES", 1500)
    found = mincut.minimum_cut(graphs.linked_copies(spark, "/root/testdata/sf0.001")).first()
    assert (found.cut_value, len(found.side), found.variant, found.probability) == (5, 210, "exact", 1.0)
    # the least cut is the weakest vertex, which contraction would have joined
    star = spark.createDataFrame([(0, i, 2 + (i > 1)) for i in range(1, 5)], "src long, dst long, weight long")
    monkeypatch.setattr(mincut, "EXACT_EDGES", 1)
    assert mincut.minimum_cut(star).first()[:2] == (2, [1])


def test_trials_of_a_graph_larger_than_a_task_draw_by_task(spark, monkeypatch):
    """No copy of all edges a trial is written: each task contracts the edges that a trial draws, and returns what is left."""
    from graphloom.operators import edges as E
    from graphloom.operators import mincut
    from graphloom.plans import graphs
    from graphloom.session import Workspace

    monkeypatch.setattr(mincut, "LOCAL_EDGES", 1500)
    clean, steps = E.merged(graphs.linked_copies(spark, "/root/testdata/sf0.001")), []
    now = mincut._drawn_by_task(clean, 3, 40, 0, Workspace(spark, "test"), steps)
    rows = now.collect()
    mapping = {(r.trial, r.old): r.new for r in steps[0].mapping.collect()}
    for t in range(3):
        want = {}
        for r in clean.collect():
            a, b = sorted(mapping.get((t, v), v) for v in (r.src, r.dst))
            if a != b:
                want[a, b] = want.get((a, b), 0) + r.weight
        assert {(r.src, r.dst): r.weight for r in rows if r.trial == t} == want and 40 <= len({v for e in want for v in e}) < 400


def test_trials_of_a_graph_larger_than_a_task_see_it_contracted(spark, monkeypatch):
    """Without pruning too: what no cut below the least weighted degree separates is joined before the first trial."""
    seen, trials = [], mincut._trials
    monkeypatch.setattr(mincut, "LOCAL_EDGES", 1500)
    monkeypatch.setattr(mincut, "_trials", lambda edges, *rest: seen.append(edges.count()) or trials(edges, *rest))
    con = duckdb.connect()
    for name in ("lineitem", "region"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    want = con.execute(plans.ORACLES["planted_cut_low"]).fetchall()
    assert [tuple(r) for r in plans.QUERIES["planted_cut_low"](spark, DATA).collect()] == want
    assert seen and max(seen) <= 5


def test_all_planned_trials_run_or_are_proved_needless(spark, monkeypatch):
    """The query asks for no fewer trials than planned; a first wave that misses the cut decides nothing, and a graph that no bound contracts gets its whole plan."""
    found, real = [], mincut.minimum_cut
    monkeypatch.setattr(mincut, "minimum_cut", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    got = plans.QUERIES["planted_cut_low"](spark, DATA).first()
    assert (got.cut_value, got.side_size) == (5, 210) and found[0].first().probability >= 0.95
    monkeypatch.setattr(mincut, "minimum_cut", real)
    calls, trials = [], mincut._trials

    def missing(edges, size, count, seed):
        calls.append((edges.count(), count))
        lone = spark.createDataFrame([(0, 10**6, [0])], "trial long, cut_value long, side array<long>")
        return lone if len(calls) == 1 else trials(edges, size, count, seed)

    monkeypatch.setattr(mincut, "_trials", missing)
    rows = planted(random.Random(2), 160, 7)
    got = mincut.minimum_cut(frame(spark, rows), exact_vertices=1, prune=False).first()
    assert (got.cut_value, got.side) == (7, list(range(160))) and len(calls) > 1 and got.probability >= 0.95
    calls.clear()
    ring = [(i, (i + 1) % 150, 1) for i in range(150)]
    got = mincut.minimum_cut(frame(spark, ring), exact_vertices=1, prune=False).first()
    want = theory.cut_trials(150, 150, 0.95)
    assert (got.cut_value, got.trials, got.probability) == (2, want, 0.95) and sum(n for _, n in calls) == want > 4
