"""Maximum flow of graphs that fit in one task, and bipartite matching: kernels, operators that run them by group, and matching by joins of graphs of any size."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace, prepare
from .components import small_or_large as connected_components
from .kernels import dense_ids

#: Edges of a graph that is given to one task.
MAX_EDGES = 5_000_000
#: Edges up to which a bipartite graph's components are given to tasks; rows of a table that a join with all its edges may broadcast (8 or 16 bytes each).
MATCH_EDGES, BROADCAST_ROWS = 2_000_000, 500_000


def max_flow(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, s: int, t: int) -> tuple[int, np.ndarray]:
    """(value, side of s) of an undirected graph's maximum flow from s to t, by blocking flows in level graphs."""
    heads: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        if a != b:
            heads[a].append(len(to))
            to.append(b)
            room.append(w)
            heads[b].append(len(to))
            to.append(a)
            room.append(w)
    total = 0
    while True:
        level = [-1] * n
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in heads[v]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return total, np.array(level) >= 0
        at = [0] * n
        while True:
            path, v = [], s
            while v != t:
                while at[v] < len(heads[v]) and not (room[heads[v][at[v]]] > 0 and level[to[heads[v][at[v]]]] == level[v] + 1):
                    at[v] += 1
                if at[v] < len(heads[v]):
                    path.append(heads[v][at[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
            if not path:
                break
            pushed = min(room[e] for e in path)
            for e in path:
                room[e] -= pushed
                room[e ^ 1] += pushed
            total += pushed


def st_min_cut(edges: DataFrame, s: int, t: int) -> DataFrame:
    """(cut_value, side of s) of the least cut between two vertices. For graphs of MAX_EDGES edges at most, which is checked."""
    if edges.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, names = dense_ids(np.append(pdf["src"].to_numpy(), s), np.append(pdf["dst"].to_numpy(), t))
        value, side = max_flow(len(names), a[:-1], b[:-1], pdf["weight"].to_numpy(), int(a[-1]), int(b[-1]))
        return pd.DataFrame({"cut_value": [value], "side": [sorted(names[side].tolist())]})

    prepare(edges.sparkSession)
    return edges.select("src", "dst", "weight").groupBy(F.lit(0).alias("all")).applyInPandas(run, "cut_value long, side array<long>")


def matching(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A maximum matching of a bipartite graph with 0 .. on each side, by shortest augmenting paths."""
    n, m = int(left.max()) + 1, int(right.max()) + 1
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        near[a].append(b)
    mate_left, mate_right = [-1] * n, [-1] * m
    while True:
        level = [0 if mate_left[a] < 0 else -1 for a in range(n)]
        queue = deque(a for a in range(n) if level[a] == 0)
        free = False
        while queue:
            a = queue.popleft()
            for b in near[a]:
                c = mate_right[b]
                if c < 0:
                    free = True
                elif level[c] < 0:
                    level[c] = level[a] + 1
                    queue.append(c)
        if not free:
            return [(a, b) for a, b in enumerate(mate_left) if b >= 0]
        at = [0] * n
        for root in range(n):
            if mate_left[root] >= 0:
                continue
            stack = [root]
            while stack:
                a = stack[-1]
                if at[a] == len(near[a]):
                    level[a] = -2
                    stack.pop()
                    if stack:
                        at[stack[-1]] += 1
                    continue
                c = mate_right[near[a][at[a]]]
                if c < 0:
                    for v in stack:
                        b = near[v][at[v]]
                        mate_left[v], mate_right[b] = b, v
                    break
                if level[c] == level[a] + 1:
                    stack.append(c)
                else:
                    at[a] += 1


def bipartite_matching(edges: DataFrame, task_edges: int = MATCH_EDGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(src, dst) of a maximum matching between sources and destinations (distinct vertex sets). A graph of task_edges edges or fewer, which are counted, is solved by component, each in a task of its own; a larger one as tables."""
    pairs = edges.select("src", "dst").filter("src is not null and dst is not null")
    if pairs.count() > task_edges:
        return _matched_tables(pairs, broadcast_rows)
    pairs = pairs.distinct()
    labelled = connected_components(pairs).toDF("src", "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, a = np.unique(pdf["src"].to_numpy(), return_inverse=True)
        right, b = np.unique(pdf["dst"].to_numpy(), return_inverse=True)
        found = matching(a, b)
        return pd.DataFrame({"src": [left[i] for i, _ in found], "dst": [right[j] for _, j in found]}, dtype="int64")

    return pairs.join(labelled, "src").groupBy("component").applyInPandas(run, "src long, dst long")


def _matched_tables(pairs: DataFrame, broadcast_rows: int) -> DataFrame:
    """A maximum matching by joins. The vertices a of the smaller side first propose to free neighbours b until none has any; then every phase grows
    a forest of alternating paths from the free a, level by level, each b in one tree, and turns one shortest path a tree. It ends when no level holds a free b, so that no augmenting path is left.
    """
    spark = prepare(pairs.sparkSession)
    work = Workspace(spark, "matching")
    counts = pairs.agg(F.approx_count_distinct("src").alias("src"), F.approx_count_distinct("dst").alias("dst")).first()
    sides = ("src", "dst") if counts["src"] <= counts["dst"] else ("dst", "src")
    # dealt and sorted by a, so that sums by a need no further exchange of all edges; the rows of an edge may repeat
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = work.write(pairs.select(F.col(sides[0]).alias("a"), F.col(sides[1]).alias("b")).repartition(parts, "a").sortWithinPartitions("a"), "pairs")
    known = work.write(pairs.select("a").distinct(), "known")
    matched, i = work.write(pairs.limit(0), "matched-0"), 0

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= broadcast_rows else table

    def grown(new: DataFrame) -> DataFrame:
        nonlocal i
        i += 1
        table = work.write(matched.join(new, "a", "left_anti").union(new.select("a", "b")), f"matched-{i}")
        work.drop(f"matched-{i - 1}")
        return table

    open_, at = pairs, 0
    while True:
        proposed = open_.groupBy("a").agg(F.min_by("b", F.xxhash64("a", "b", F.lit(at))).alias("b"))
        new = work.write(proposed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), f"new-{at}")
        if new.isEmpty():
            break
        matched = grown(new)
        free = work.write(known.join(matched, "a", "left_anti"), f"free-{at}")
        open_ = work.write(open_.join(small(free), "a", "left_semi").join(matched, "b", "left_anti").select("a", "b"), f"open-{at}")
        for name in (f"new-{at}", f"free-{at}", f"open-{at - 1}"):
            work.drop(name)
        at += 1
    phase = 0
    while True:
        phase += 1
        roots = work.write(known.join(matched, "a", "left_anti").select("a", F.col("a").alias("root")), f"roots-{phase}")
        front, levels, ends = roots, [], None
        while not front.isEmpty():
            name = f"{phase}-{len(levels)}"
            reached = pairs.join(small(front), "a")
            for earlier in levels:
                reached = reached.join(earlier, "b", "left_anti")
            best = reached.groupBy("b").agg(F.min(F.struct(F.xxhash64("root", "b").alias("score"), "a", "root")).alias("best"))
            level = work.write(best.select("b", "best.a", "best.root"), f"level-{name}")
            levels.append(level)
            ends = work.write(level.join(matched, "b", "left_anti").groupBy("root").agg(F.min("b").alias("b")), f"ends-{name}")
            if not ends.isEmpty():
                break
            front = work.write(level.select("b", "root").join(matched, "b").select("a", "root"), f"front-{name}")
        if front.isEmpty():
            return matched.select(F.col("a").alias(sides[0]), F.col("b").alias(sides[1])).select("src", "dst")
        turned = None
        for k, level in reversed(list(enumerate(levels))):
            step = work.write(ends.select("b").join(level, "b").select("a", "b"), f"turned-{phase}-{k}")
            turned = step if turned is None else turned.union(step)
            ends = step.select("a").join(matched, "a").select("b")
        matched = grown(turned)
        for k in range(len(levels)):
            for name in ("level", "ends", "front", "turned"):
                work.drop(f"{name}-{phase}-{k}")
        work.drop(f"roots-{phase}")
