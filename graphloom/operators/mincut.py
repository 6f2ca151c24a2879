"""Minimum cuts: exact for small graphs, by repeated random contraction for larger ones, approximate for the largest.

The plan is chosen by size. Trials run in waves: what no cut below the best so far separates is contracted after each, and how many trials are still wanted is planned anew for what is left. Every path first sums parallel edges, checks connectivity (a graph of several components
has cut 0) and contracts edges that no minimum cut can hold. What is left is solved exactly in one task, or trials of random
contraction run as tasks over one broadcast copy of the graph, whose size is checked, or - where it is too large for that - trials shrink it as one
distributed graph keyed by trial before each is solved in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rand, theory
from ..session import Workspace, prepare
from . import edges as E
from .components import small_or_large as connected_components
from .kernels import component_labels, cut_trial, dense_ids, forest_cut, inseparable

#: Vertices and edges up to which a graph is solved exactly in one task; edges up to which it is broadcast (24 bytes each).
EXACT_VERTICES, EXACT_EDGES, BROADCAST_EDGES = 500_000, 2_000_000, 2_000_000
#: Edges that a task holds at a time when it joins what they prove inseparable; with half as many they prove far less.
LOCAL_EDGES = 2_000_000
#: Vertices of a shrunk trial that one task works off; the recursion of larger ones is dealt out branch by branch.
TASK_VERTICES = 4096
#: Trials of the first wave; each further one has twice as many.
FIRST_WAVE = 4
RESULT = "cut_value long, side array<long>, variant string, trials long, probability double"


@dataclass
class Prepared:
    """The graph as it is cut, and what its vertices stand for: names (vertex, component); labels (vertex, component) of its connected components; bound and weakest: the least weighted degree of the input, and its least vertex."""

    edges: DataFrame
    vertices: int
    rows: int
    connected: bool
    names: DataFrame
    labels: DataFrame
    bound: int
    weakest: int
    contracted: bool


def _merged(edges: DataFrame, vertices: DataFrame | None, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(edges, degrees): summed edges of positive weight, and (vertex, weight) of all vertices. Edges are dealt by ranges of one end, so that tasks that read them hold dense parts of the graph; a vertex without an edge is a row of weight 0."""
    counts = F.when((F.col("src") != F.col("dst")) & (F.col("weight") > 0), F.col("weight")).otherwise(0)
    rows = E.canonical(edges.select("src", "dst", counts.alias("weight")))
    if vertices is not None:
        rows = rows.union(vertices.select(F.col("vertex").alias("src"), F.col("vertex").alias("dst"), F.lit(0).cast("long").alias("weight")))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.sparkSession.sparkContext.defaultParallelism)
    summed = rows.repartitionByRange(parts, "dst").groupBy("src", "dst").agg(F.sum("weight").cast("long").alias("weight")).sortWithinPartitions("dst", "src")
    all_ = work.write(summed, "merged")
    degrees = work.write(E.degrees(all_).select("vertex", "weight"), "degrees")
    return all_.filter("weight > 0"), degrees


def _by_task(edges: DataFrame, bound: int) -> DataFrame:
    """(src, dst, weight): each task joins what its edges prove inseparable by cuts below bound (connected, for bound 1) and returns rows of weight 0 from a vertex to what it was joined to, and the edges that are left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def joined() -> pd.DataFrame:
            src, dst, weight = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("src", "dst", "weight"))
            held.clear()
            a, b, names = dense_ids(src, dst)
            del src, dst
            found = inseparable(len(names), a, b, weight, bound)
            moved, left = np.flatnonzero(found != np.arange(len(names))), found[a] != found[b]
            return pd.DataFrame({"src": np.append(names[moved], names[found[a[left]]]), "dst": np.append(names[found[moved]], names[found[b[left]]]), "weight": np.append(np.zeros(len(moved), np.int64), weight[left])})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= LOCAL_EDGES:
                yield joined()
        if held:
            yield joined()

    return edges.mapInPandas(run, "src long, dst long, weight long")


def _components(edges: DataFrame, rows: int, work: Workspace) -> DataFrame:
    """connected_components; of many edges only a forest of each task's part goes through the rounds of joins."""
    if rows > LOCAL_EDGES:
        edges = work.write(_by_task(edges, 1).select("src", "dst").distinct(), "forest")
    return connected_components(edges)


def _tightened(graph: Prepared, bound: int, work: Workspace, name: str) -> Prepared:
    """graph with contracted what no cut below bound separates, as far as its tasks prove it; of LOCAL_EDGES or fewer by one task, so that partitions do not matter."""
    clean, names, rows, i = graph.edges, graph.names, graph.rows, 0
    while rows and bound:
        found = work.write(_by_task(clean.coalesce(1) if rows <= LOCAL_EDGES else clean, bound), f"{name}-by-task-{i}")
        joined = found.filter("weight = 0").select("src", "dst").distinct()
        if joined.isEmpty():
            break
        mapping = work.write(connected_components(joined).toDF("old", "new"), f"{name}-joined-{i}")
        clean, was = work.write(E.contracted(found.filter("weight > 0"), mapping), f"{name}-{i}"), rows
        names, rows = work.write(E.composed(names, mapping), f"{name}-names-{i}"), clean.count()
        for old in (f"by-task-{i}", f"joined-{i}", f"{i - 1}", f"names-{i - 1}"):
            work.drop(f"{name}-{old}")
        i += 1
        if rows > 0.9 * was:
            break
    return replace(graph, edges=clean, names=names, rows=rows, vertices=names.select("component").distinct().count(), contracted=True) if i else graph


def _prepared(clean: DataFrame, degrees: DataFrame, work: Workspace, prune: bool) -> Prepared:
    n, weakest = degrees.agg(F.count("*"), F.min(F.struct("weight", "vertex"))).first()
    names = degrees.select("vertex", F.col("vertex").alias("component"))
    graph = Prepared(clean, n, clean.count(), False, names, names, weakest["weight"], weakest["vertex"], False)
    if prune:
        graph = _tightened(graph, graph.bound, work, "pruned")
    labels = work.write(_components(graph.edges, graph.rows, work), "labels")
    known, roots = labels.agg(F.count("*"), F.count_distinct("component")).first()
    return replace(graph, connected=roots + graph.vertices - known == 1, labels=labels)


def minimum_cut(edges: DataFrame, vertices: DataFrame | None = None, success: float = 0.95, seed: int = 0, prune: bool = True, exact_vertices: int = EXACT_VERTICES, broadcast_edges: int = BROADCAST_EDGES, max_trials: int | None = None, sides: bool = True, task_vertices: int = TASK_VERTICES) -> DataFrame:
    """One row: cut_value, side (the vertices of the smaller side, by least vertex on ties), variant, trials, probability (that the value is the minimum).

    edges (src, dst, weight): undirected, parallel ones add up, loops and weights that are not positive do not count. vertices (vertex) adds isolated
    ones. Of a graph that is not connected the value is 0 and side the component of the least vertex; with fewer than two vertices value and side are null.
    prune contracts what no cut below the least weighted degree separates before any trial; a graph of more than LOCAL_EDGES edges is so contracted in any case.
    As many trials run as reach success together, in waves between which the graph is contracted by the best cut so far; where one vertex is left, that cut is proved. max_trials stops earlier, and lowers probability by that.
    Results depend on the seed, not on partitions. side lists the vertices of one side in one row; it is null without sides, which is what large graphs want.
    """
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "mincut")
    clean, degrees = _merged(edges, vertices, work)
    n = degrees.count()
    if n < 2:
        return spark.createDataFrame([(None, None, "none", 0, 1.0)], RESULT)
    if n <= exact_vertices and clean.count() <= EXACT_EDGES:
        return _exact(clean, degrees.select("vertex"), sides)
    prune = prune or clean.count() > LOCAL_EDGES
    graph = _prepared(clean, degrees, work, prune)
    if not graph.connected and not sides:
        return spark.createDataFrame([(0, None, "disconnected", 0, 1.0)], RESULT)
    if not graph.connected:
        of = graph.labels.toDF("old", "new")
        whole = work.write(E.composed(graph.names, of), "whole")
        first = whole.agg(F.min("component").alias("component"))
        return whole.join(F.broadcast(first), "component").agg(F.sort_array(F.collect_list("vertex")).alias("side")).select(F.lit(0).cast("long").alias("cut_value"), "side", F.lit("disconnected").alias("variant"), F.lit(0).cast("long").alias("trials"), F.lit(1.0).alias("probability"))
    best: Wave | None = None  # none: the weakest vertex
    bound, tried, waves, run, share, proved, variant = graph.bound, graph.bound if prune else None, 0, 0, 0.0, graph.vertices < 2, "exact"
    while not proved and share < 1.0 - 1e-9 and (not max_trials or run < max_trials):
        steps: list[Contraction] = []
        if graph.contracted and graph.vertices <= exact_vertices and graph.rows <= EXACT_EDGES:
            result, variant, proved, trials = _exact(graph.edges, E.vertices(graph.edges), True).select(F.lit(0).cast("long").alias("trial"), "cut_value", "side"), "exact", True, 1
        else:
            planned = max(1, theory.cut_trials(graph.vertices, graph.rows, success))
            trials = max(1, min(FIRST_WAVE << waves, math.ceil((1.0 - share) * planned - 1e-9), max_trials - run if max_trials else planned))
            size, drawn = theory.intermediate_size(graph.vertices, graph.rows), seed + 1_299_709 * waves
            if graph.rows <= broadcast_edges:
                result, kind = _trials(graph.edges, size, trials, drawn), "low"
            else:
                result, kind = _shrunk_trials(graph.edges, graph.vertices, size, trials, drawn, Workspace(spark, "mincut-wave"), task_vertices, steps), "high"
            variant = variant if waves else kind
            share += trials / planned
        found = work.write(result.agg(F.min(F.struct("cut_value", "trial", "side")).alias("best")).select("best.cut_value", "best.trial", "best.side"), f"best-{waves}")
        value, trial = found.select("cut_value", "trial").first()
        # what was contracted keeps only the cuts below the bound
        if value < bound or value == bound and best is None and not graph.contracted:
            best, bound = Wave(found, trial, graph.names, steps), value
        waves, run = waves + 1, run + trials
        if not proved and share < 1.0 - 1e-9 and (not max_trials or run < max_trials) and bound != tried:
            graph, tried = _tightened(graph, bound, work, f"wave-{waves}"), bound
            proved = graph.vertices < 2
    reached = 1.0 if proved else success if share >= 1.0 - 1e-9 else 1.0 - (1.0 - success) ** share
    plan = [F.lit(variant).alias("variant"), F.lit(max(1, run)).cast("long").alias("trials"), F.lit(float(reached)).alias("probability")]
    if best is None or not sides:
        return spark.createDataFrame([(bound, [graph.weakest] if sides else None)], "cut_value long, side array<long>").select("cut_value", "side", *plan)
    # from vertices to what stands for them in the graph that the wave saw, and for that in the best trial's shrunk one
    names = best.names
    for i, step in enumerate(best.steps):
        names = E.composed(names, step.mapping.filter(F.col("trial") == best.trial >> step.branchings_after).select("old", "new"))
        if i % 8 == 7:
            names = work.write(names, f"names-{i}")
    inside = best.found.select(F.explode("side").alias("component"), F.lit(1).alias("inside"))
    names = work.write(names.join(inside, "component", "left").select("vertex", F.coalesce("inside", F.lit(0)).alias("inside")), "sides")
    sizes = names.groupBy("inside").agg(F.count("*").alias("size"), F.min("vertex").alias("least"))
    smaller = sizes.orderBy("size", "least").limit(1).select("inside")
    side = names.join(F.broadcast(smaller), "inside").agg(F.sort_array(F.collect_list("vertex")).alias("side"))
    return side.select(F.lit(bound).cast("long").alias("cut_value"), "side", *plan)


@dataclass
class Contraction:
    """A step of shrinking trials: (trial, old, new), and how often trials have branched in two since."""

    mapping: DataFrame
    branchings_after: int = 0


@dataclass
class Wave:
    """The best cut of a wave of trials: found (cut_value, trial, side), its trial, the names of the graph that the wave saw, and how its trials shrank."""

    found: DataFrame
    trial: int
    names: DataFrame
    steps: list[Contraction]


_TRIAL = "trial long, cut_value long, side array<long>"


def _exact(clean: DataFrame, known: DataFrame, sides: bool) -> DataFrame:
    """The result by maximum-adjacency orders; one task, for graphs of a checked size. Every vertex comes as a loop too, so that isolated ones count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, names = dense_ids(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        real = a != b
        a, b, weight = a[real], b[real], pdf["weight"].to_numpy()[real]
        labels = component_labels(len(names), a, b)
        if labels.any():  # not all vertices reach the least one
            value, side, variant, trials = 0, labels == 0, "disconnected", 0
        else:
            value, side = forest_cut(len(names), a, b, weight)
            variant, trials = "exact", 1
            if 2 * side.sum() > len(side) or 2 * side.sum() == len(side) and not side[0]:
                side = ~side
        return pd.DataFrame({"cut_value": [value], "side": [names[side].tolist() if sides else None], "variant": [variant], "trials": [trials], "probability": [1.0]})

    loops = known.select(F.col("vertex").alias("src"), F.col("vertex").alias("dst"), F.lit(0).cast("long").alias("weight"))
    return clean.union(loops).groupBy(F.lit(0).alias("all")).applyInPandas(run, RESULT)


def _trials(edges: DataFrame, size: int, trials: int, seed: int) -> DataFrame:
    """Independent trials as tasks over a broadcast copy of the edges."""
    spark = edges.sparkSession
    table = edges.orderBy("src", "dst").toArrow()
    a, b, names = dense_ids(table.column("src").to_numpy(), table.column("dst").to_numpy())
    shared = spark.sparkContext.broadcast((a, b, table.column("weight").to_numpy(), names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, dst, weight, names = shared.value
        best: tuple[int, int, np.ndarray] | None = None
        for batch in batches:
            for trial in batch["id"].tolist():
                value, side = cut_trial(len(names), src, dst, weight, size, seed * 1_000_003 + trial)
                if best is None or (value, trial) < best[:2]:
                    best = value, trial, side
        if best is not None:  # a row a task
            yield pd.DataFrame({"trial": [best[1]], "cut_value": [best[0]], "side": [sorted(names[best[2]].tolist())]})

    tasks = max(1, min(trials, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, trials, 1, tasks).mapInPandas(run, _TRIAL)


def shrink(edges: DataFrame, trials: int, vertices: int, size: int, seed: int, work: Workspace, rounds: int = 40, steps: list[Contraction] | None = None) -> DataFrame:
    """(trial, src, dst, weight): for each trial the graph contracted by weight at random to at most size vertices and usually just these.

    All trials are one table keyed by trial. In a round each trial scores its edges and contracts the shortest prefix of a weighted sample that does not go below size.
    steps gets the contraction of each round.
    """
    now = _drawn_by_task(edges, trials, size, seed, work, steps) if edges.count() > LOCAL_EDGES else None
    if now is None:
        now = work.write(edges.select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "src", "dst", "weight"), "trials-0")
    return _contracted(now, "trials", vertices, size, seed, work, rounds, steps)


def _drawn_by_task(edges: DataFrame, trials: int, size: int, seed: int, work: Workspace, steps: list[Contraction] | None) -> DataFrame | None:
    """A first round of shrink without a copy of all edges a trial: the edges whose scores lie below a limit are contracted, first within each task, which returns what is left for each trial.

    The limit is the greatest of a series at which twice size vertices are expected to have no such edge, so that more than size vertices are left. None where there is no such limit, or trial and vertex do not fit a long.
    """
    degrees = work.write(E.degrees(edges).select("vertex", "weight"), "ends")
    low, high, most = degrees.agg(F.min("vertex"), F.max("vertex"), F.max("weight")).first()
    limits = [2.0 ** (-j / 4) * 64 for j in range(4 * (int(most).bit_length() + 12))]
    alone = degrees.agg(*(F.sum(F.exp(-F.col("weight") * F.lit(x))).alias(f"x{j}") for j, x in enumerate(limits))).first()
    fit = [x for j, x in enumerate(limits) if alone[j] >= 2 * size]
    if not fit or low < 0 or high >= 2**62 // trials or alone[limits.index(fit[0])] > 0.5 * degrees.count():
        return None
    parts = []
    for base in range(0, trials, 32):
        group = range(base, min(trials, base + 32))
        drawn = sum((F.when(rand.exponential(F.col("weight"), seed * 7919, F.lit(t), "src", "dst") <= fit[0], F.lit(1 << (t - base))).otherwise(F.lit(0)).cast("long") for t in group), F.lit(0).cast("long"))

        def run(batches: Iterator[pd.DataFrame], group: range = group, base: int = base) -> Iterator[pd.DataFrame]:
            def joined(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                pdf = pd.concat(held)
                a, b, names = dense_ids(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
                weight, mask, n = pdf["weight"].to_numpy(), pdf["drawn"].to_numpy(), len(names)
                for t in group:
                    taken = mask >> (t - base) & 1 == 1
                    found = component_labels(n, a[taken], b[taken])
                    moved, low, high = np.flatnonzero(found != np.arange(n)), np.minimum(found[a], found[b]), np.maximum(found[a], found[b])
                    apart = low != high
                    key, where = np.unique(low[apart] * n + high[apart], return_inverse=True)
                    summed = np.zeros(len(key), np.int64)
                    np.add.at(summed, where, weight[apart])
                    src, dst = np.append(names[moved], names[key // n]), np.append(names[found[moved]], names[key % n])
                    yield pd.DataFrame({"trial": np.full(len(src), t, np.int32), "src": src, "dst": dst, "weight": np.append(np.zeros(len(moved), np.int64), summed)})

            held: list[pd.DataFrame] = []
            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= LOCAL_EDGES:
                    yield from joined(held)
                    held = []
            if held:
                yield from joined(held)

        parts.append(work.write(edges.select("src", "dst", "weight", drawn.alias("drawn")).mapInPandas(run, "trial int, src long, dst long, weight long"), f"drawn-{base}"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    one = lambda c: F.col(c) * trials + F.col("trial")
    labels = connected_components(found.filter("weight = 0").select(one("src").alias("src"), one("dst").alias("dst")).distinct())
    split = lambda c: F.expr(f"{c} div {trials}")
    mapping = work.write(labels.filter("vertex <> component").select((F.col("vertex") % trials).cast("int").alias("trial"), split("vertex").cast("long").alias("old"), split("component").cast("long").alias("new")), "drawn-map")
    if steps is not None:
        steps.append(Contraction(mapping))
    moved = found.filter("weight > 0").join(mapping.toDF("trial", "src", "__src"), ["trial", "src"], "left").join(mapping.toDF("trial", "dst", "__dst"), ["trial", "dst"], "left")
    now = work.write(E.merged_by(moved.select("trial", F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst"), "weight"), ["trial"]), "trials-0")
    for base in range(0, trials, 32):
        work.drop(f"drawn-{base}")
    return now


def _contracted(now: DataFrame, name: str, vertices: int, size: int, seed: int, work: Workspace, rounds: int = 40, steps: list[Contraction] | None = None) -> DataFrame:
    """shrink of a table that is keyed by trial already, written as name-0."""
    sample = theory.sample_size_weighted(vertices)
    for i in range(1, rounds + 1):
        ends = now.select("trial", F.explode(F.array("src", "dst")).alias("v"))
        counts = ends.distinct().groupBy("trial").agg(F.count("*").alias("n"))
        open_ = work.write(counts.filter(F.col("n") > size), f"{name}-open-{i}")
        if open_.isEmpty():
            break
        score = rand.exponential(F.col("weight"), seed * 7919 + i, "trial", "src", "dst")
        # of scores with rates w, about sample lie below sample / sum of w: a threshold without ranking all edges
        lots = now.join(open_, "trial").withColumn("score", score)
        limits = lots.groupBy("trial").agg(F.sum("weight").alias("total")).select("trial", (F.lit(float(sample)) / F.col("total")).alias("limit"))
        drawn = lots.join(limits, "trial").filter(F.col("score") <= F.col("limit")).select("trial", "src", "dst", "score", "n")

        def contract(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["score", "src", "dst"])
            a, b, names = dense_ids(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
            n, spare = int(pdf["n"].iloc[0]), len(names)
            low, high = 0, len(a)
            while low < high:  # the longest prefix that leaves size vertices or more
                middle = (low + high + 1) // 2
                left = n - spare + len(np.unique(component_labels(spare, a[:middle], b[:middle])))
                low, high = (middle, high) if left >= size else (low, middle - 1)
            found = component_labels(spare, a[:low], b[:low])
            moved = np.flatnonzero(found != np.arange(spare))
            return pd.DataFrame({"trial": np.full(len(moved), pdf["trial"].iloc[0]), "old": names[moved], "new": names[found[moved]]})

        mapping = work.write(drawn.groupBy("trial").applyInPandas(contract, "trial int, old long, new long"), f"{name}-map-{i}")
        if steps is not None:
            steps.append(Contraction(mapping))
        first, second = mapping.toDF("trial", "src", "__src"), mapping.toDF("trial", "dst", "__dst")
        moved = now.join(first, ["trial", "src"], "left").join(second, ["trial", "dst"], "left")
        after = moved.select("trial", F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst"), "weight")
        now = work.write(E.merged_by(after, ["trial"]), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        if mapping.isEmpty() and i > 3:
            break
    return now


def _shrunk_trials(edges: DataFrame, vertices: int, size: int, trials: int, seed: int, work: Workspace, task_vertices: int, steps: list[Contraction]) -> DataFrame:
    """Trials that shrink as one distributed graph keyed by trial and, while they are larger than a task's share, branch in two and shrink on, as the recursion does; each branch is then solved in a task of its own.

    A branch of trial t is trial 2 t or 2 t + 1, so that a trial's number over two to the branchings names the graph it came from.
    """
    now, level = shrink(edges, trials, vertices, size, seed, work, steps=steps), 0
    while size > max(task_vertices, theory.BASE_CASE) and theory.contraction_target(size) < size:
        level += 1
        for step in steps:
            step.branchings_after += 1
        branched = now.select(F.explode(F.array(F.col("trial") * 2, F.col("trial") * 2 + 1)).alias("trial"), "src", "dst", "weight")
        smaller = theory.contraction_target(size)
        now = _contracted(work.write(branched, f"branch-{level}-0"), f"branch-{level}", size, smaller, seed + 104_729 * level, work, steps=steps)
        size = smaller

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, names = dense_ids(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        trial = int(pdf["trial"].iloc[0])
        value, side = cut_trial(len(names), a, b, pdf["weight"].to_numpy(), len(names), seed * 1_000_003 + trial)
        return pd.DataFrame({"trial": [trial], "cut_value": [value], "side": [sorted(names[side].tolist())]})

    # a side here is of shrunk vertices only; minimum_cut names what they stand for
    return now.groupBy("trial").applyInPandas(run, _TRIAL)


def approximate_cut(edges: DataFrame, vertices: DataFrame | None = None, success: float = 0.9, seed: int = 0, levels_at_once: int = 6) -> DataFrame:
    """One row: weight (within a logarithmic factor of the minimum cut, with the given probability), level, trials, found.

    On each level every edge keeps each of its weight copies at 2**-level; the first level on which all trials' graphs together
    have more components than trials gives 2**level. Several levels are tried at once, as one disjoint graph keyed by level and trial. A graph that is not
    connected has weight 0, one that no level disconnects has found false and its total weight as an upper bound.
    """
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "approximate")
    graph = _prepared(*_merged(edges, vertices, work), work, prune=False)
    schema = "weight long, level int, trials long, found boolean"
    if not graph.connected or graph.vertices < 2:
        return spark.createDataFrame([(0, 0, 0, True)], schema)
    trials = theory.approximate_trials(success)
    total = graph.edges.agg(F.sum("weight")).first()[0]
    most = max(1, int(total).bit_length() + 1)
    names = work.write(E.relabel_sorted(graph.edges), "names")
    numbered = work.write(E.relabel(graph.edges, names), "numbered")
    n = graph.vertices
    for low in range(1, most + 1, levels_at_once):
        levels = range(low, min(most, low + levels_at_once - 1) + 1)
        copies = numbered.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
        kept = copies.filter(rand.survives(F.col("weight"), F.col("level"), seed, "src", "dst", "level", "trial"))
        offset = ((F.col("level") - low) * trials + F.col("trial")).cast("long") * n
        found = connected_components(kept.select((F.col("src") + offset).alias("src"), (F.col("dst") + offset).alias("dst")))
        # vertices without an edge are components of their own
        joined = found.groupBy(F.floor(F.col("vertex") / (n * trials)).alias("at")).agg((F.count("*") - F.countDistinct("component")).alias("joined"))
        joined = {r["at"]: r["joined"] for r in joined.collect()}  # a row a level
        for level in levels:
            if n * trials - joined.get(level - low, 0) > trials:
                return spark.createDataFrame([(2**level, level, trials, True)], schema)
    return spark.createDataFrame([(int(total), most, trials, False)], schema)
