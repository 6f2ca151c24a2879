"""Iterative graph algorithms as loops of joins and aggregations; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rand
from ..session import Workspace, prepare
from . import edges as E
from .components import small_or_large as connected_components


def bfs_levels(edges: DataFrame, sources: list[int], directed: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(vertex, level): the least number of edges from any source, for vertices that can be reached."""
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "bfs")
    links = work.write((edges if directed else E.symmetric(edges)).select("src", "dst").distinct(), "links")
    front = work.write(spark.createDataFrame([(s, 0) for s in set(sources)], "vertex long, level int"), "level-0")
    seen = [front]
    for level in range(1, max_rounds):
        known = seen[0]
        for more in seen[1:]:
            known = known.union(more)
        reached = links.join(front, links["src"] == front["vertex"]).select(F.col("dst").alias("vertex")).distinct()
        front = work.write(reached.join(known, "vertex", "left_anti").select("vertex", F.lit(level).alias("level")), f"level-{level}")
        if front.isEmpty():
            return known
        seen.append(front)
        if len(seen) > 16:
            seen = [work.write(known.union(front), f"known-{level}")]
    raise RuntimeError("the search did not end")


def eccentricity(edges: DataFrame, source: int) -> tuple[int, int]:
    """(level, vertex): how far the farthest vertex is from source, and the least such vertex."""
    far = bfs_levels(edges, [source]).agg(F.max(F.struct(F.col("level"), (-F.col("vertex")).alias("v"))).alias("best")).first()["best"]
    return far["level"], -far["v"]


def diameter_estimate(edges: DataFrame, source: int, sweeps: int = 4) -> int:
    """A lower bound of the diameter: repeated search from the farthest vertex found."""
    best = 0
    for _ in range(sweeps):
        level, source = eccentricity(edges, source)
        if level <= best:
            break
        best = level
    return best


def shortest_paths(edges: DataFrame, sources: list[int], directed: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(source, vertex, distance): least sums of weights (not negative) from each source, by rounds of relaxation of what has changed."""
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "paths")
    both = (edges if directed else E.symmetric(edges.select("src", "dst", "weight"))).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    links = work.write(both, "links")
    best = changed = work.write(spark.createDataFrame([(s, s, 0) for s in set(sources)], "source long, vertex long, distance long"), "best-0")
    for i in range(1, max_rounds):
        tried = links.join(changed, links["src"] == changed["vertex"]).groupBy("source", F.col("dst").alias("vertex")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        better = tried.join(best, ["source", "vertex"], "left").filter(F.col("distance").isNull() | (F.col("new") < F.col("distance")))
        changed = work.write(better.select("source", "vertex", F.col("new").alias("distance")), f"changed-{i}")
        if changed.isEmpty():
            return best
        best = work.write(best.union(changed).groupBy("source", "vertex").agg(F.min("distance").alias("distance")), f"best-{i}")
        work.drop(f"best-{i - 1}")
    raise RuntimeError("distances did not settle")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(vertex, rank) of directed edges after a number of rounds of rank = 1 - damping + damping * sum of rank / out-degree over incoming edges; ends early when no rank moves by more than tolerance."""
    work = Workspace(prepare(edges.sparkSession), "pagerank")
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = work.write(edges.select("src", "dst").join(out, "src").groupBy("src", "dst").agg((F.count("*") / F.first("out")).alias("share")), "links")
    ranks = work.write(E.vertices(edges).select("vertex", F.lit(1.0).alias("rank")), "rank-0")
    for i in range(1, rounds + 1):
        given = links.join(ranks, links["src"] == ranks["vertex"]).groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        after = work.write(ranks.join(given, "vertex", "left").select("vertex", (F.lit(1.0 - damping) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"), F.col("rank").alias("was")), f"rank-{i}")
        if tolerance is not None and after.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] <= tolerance:
            return after.select("vertex", "rank")
        ranks = after.select("vertex", "rank")
        if i > 1:
            work.drop(f"rank-{i - 2}")
    return ranks


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest by Boruvka's rounds: each piece takes its lightest edge (ties by ends), joined pieces are one from then on."""
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "forest")
    clean = E.canonical(E.without_loops(edges.select("src", "dst", "weight"))).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    rest = work.write(clean.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "src", "dst"), "rest-0")
    chosen: DataFrame | None = None
    for i in range(1, 64):
        if rest.isEmpty():
            break
        key = F.struct("weight", "src", "dst", "a", "b")
        ends = rest.select(F.explode(F.array("a", "b")).alias("piece"), key.alias("edge"))
        least = ends.groupBy("piece").agg(F.min("edge").alias("edge")).select("edge.*").distinct()
        least = work.write(least, f"least-{i}")
        picked = least.select("src", "dst", "weight")
        chosen = picked if chosen is None else chosen.union(picked)
        pieces = connected_components(least, "a", "b").toDF("old", "new")
        a, b = pieces.toDF("a", "__a"), pieces.toDF("b", "__b")
        moved = rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"), "weight", "src", "dst")
        rest = work.write(moved.filter("a <> b"), f"rest-{i}")
        work.drop(f"rest-{i - 1}")
    return chosen if chosen is not None else clean.limit(0)


def independent_set(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(vertex) of a maximal independent set by Luby's rounds with hashed priorities: a vertex before all its neighbours joins, its neighbours leave."""
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "independent")
    rest = work.write(E.symmetric(E.without_loops(E.canonical(edges.select("src", "dst")))).distinct(), "rest-0")
    everyone = work.write(E.vertices(edges), "open-0")
    chosen = work.write(everyone.limit(0), "chosen-0")
    for i in range(1, 200):
        priority = lambda c: F.struct(rand.uniform(seed + i, c), F.col(c))  # noqa: B023, E731
        beaten = rest.filter(priority("dst") < priority("src")).select(F.col("src").alias("vertex")).distinct()
        fresh = work.write(everyone.join(beaten, "vertex", "left_anti"), f"fresh-{i}")
        chosen = chosen.union(fresh)
        gone = work.write(rest.join(fresh, rest["src"] == fresh["vertex"]).select(F.col("dst").alias("vertex")).union(fresh).distinct(), f"gone-{i}")
        everyone = work.write(everyone.join(gone, "vertex", "left_anti"), f"open-{i}")
        if everyone.isEmpty():
            return chosen
        rest = work.write(rest.join(gone, rest["src"] == gone["vertex"], "left_anti").join(gone, F.col("dst") == gone["vertex"], "left_anti"), f"rest-{i}")
    raise RuntimeError("the set did not settle")


def betweenness(edges: DataFrame, sources: list[int] | None = None) -> DataFrame:
    """(vertex, score): for each vertex the shares of shortest paths from the sources (all vertices, if none are given) that pass through it, by levels forward and back. Every ordered pair counts."""
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "betweenness")
    links = work.write(E.symmetric(E.without_loops(E.canonical(edges.select("src", "dst")))).distinct(), "links")
    starts = E.vertices(edges) if sources is None else spark.createDataFrame([(s,) for s in sources], "vertex long")
    front = work.write(starts.select(F.col("vertex").alias("source"), "vertex", F.lit(0).alias("level"), F.lit(1).cast("double").alias("paths")), "level-0")
    known, levels = front, [front]
    while True:
        step = links.join(front, links["src"] == front["vertex"]).groupBy("source", F.col("dst").alias("vertex")).agg(F.sum("paths").alias("paths"))
        front = work.write(step.join(known, ["source", "vertex"], "left_anti").select("source", "vertex", F.lit(len(levels)).alias("level"), "paths"), f"level-{len(levels)}")
        if front.isEmpty():
            break
        known = known.union(front)
        levels.append(front)
    due = work.write(levels[-1].select("source", "vertex", "paths", F.lit(0.0).alias("due")), f"due-{len(levels) - 1}")
    total = due
    for i in range(len(levels) - 2, -1, -1):
        up = links.join(due, links["dst"] == due["vertex"]).select("source", F.col("src").alias("vertex"), ((1.0 + F.col("due")) / F.col("paths")).alias("part"))
        parts = up.groupBy("source", "vertex").agg(F.sum("part").alias("part"))
        due = work.write(levels[i].join(parts, ["source", "vertex"], "left").select("source", "vertex", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("due")), f"due-{i}")
        total = total.union(due)
    scores = total.filter("source <> vertex").groupBy("vertex").agg(F.sum("due").alias("score"))
    return E.vertices(edges).join(scores, "vertex", "left").select("vertex", F.coalesce("score", F.lit(0.0)).alias("score"))


def bisection(edges: DataFrame, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(vertex, side): a two-way partition by weighted label propagation from a hashed start; its cut value is an upper bound of the minimum cut, without any guarantee.

    If all vertices come to one side, the vertex of least weighted degree is put on the other.
    """
    work = Workspace(prepare(edges.sparkSession), "bisection")
    clean = work.write(E.symmetric(E.merged(edges)), "links")
    sides = work.write(clean.select(F.col("src").alias("vertex")).distinct().withColumn("side", F.floor(rand.uniform(seed, "vertex") * 2).cast("int")), "side-0")
    for i in range(1, rounds + 1):
        pull = clean.join(sides, clean["dst"] == sides["vertex"]).groupBy("src").agg(F.sum(F.when(F.col("side") == 1, F.col("weight")).otherwise(-F.col("weight"))).alias("pull"))
        # a hashed half moves at a time, so that neighbours do not swap for ever
        moves = rand.uniform(seed + i, "vertex") < 0.5
        after = sides.join(pull, sides["vertex"] == pull["src"]).select("vertex", F.when(moves & (F.col("pull") > 0), 1).when(moves & (F.col("pull") < 0), 0).otherwise(F.col("side")).alias("side"))
        sides = work.write(after, f"side-{i}")
    weakest = E.degrees(clean).agg(F.min_by("vertex", F.struct("weight", "vertex")).alias("weakest"))
    one = sides.agg((F.min("side") == F.max("side")).alias("one"))
    return sides.join(F.broadcast(one)).join(F.broadcast(weakest)).select("vertex", F.when(F.col("one") & (F.col("vertex") == F.col("weakest")), 1 - F.col("side")).otherwise(F.col("side")).alias("side"))


def kway_partition(edges: DataFrame, k: int, slack: float = 0.05, rounds: int = 8, seed: int = 0) -> DataFrame:
    """(vertex, part): parts 0 to k - 1 of at most ceil((1 + slack) n / k) vertices each, by weighted label propagation within that bound from ranges of hashed vertices.

    In a round a hashed half of the vertices asks for the part that most of its edges' weight leads to; of those that ask
    for a part, the ones that gain most move, as many as there is room. The cut is a heuristic's, without any guarantee.
    """
    work = Workspace(prepare(edges.sparkSession), "kway")
    links = work.write(E.symmetric(E.merged(edges)), "links")
    numbered = E.ranked(E.vertices(edges).withColumn("draw", rand.uniform(seed, "vertex")), ["draw", "vertex"], "place")
    n = numbered.count()
    most = -(-int((1 + slack) * n) // k) if n else 0
    most = max(most, -(-n // k))
    parts = work.write(numbered.select("vertex", F.floor(F.col("place") * k / F.lit(max(n, 1))).cast("int").alias("part")), "part-0")
    for i in range(1, rounds + 1):
        pull = links.join(parts.toDF("dst", "to"), "dst").groupBy("src", "to").agg(F.sum("weight").alias("pull"))
        best = pull.groupBy("src").agg(F.max(F.struct("pull", (-F.col("to")).alias("least"))).alias("best"))
        own = pull.join(parts.toDF("src", "to"), ["src", "to"], "left_semi").select("src", F.col("pull").alias("stays"))
        asks = best.join(parts.withColumnRenamed("vertex", "src"), "src").join(own, "src", "left").select(F.col("src").alias("vertex"), (-F.col("best.least")).alias("to"), (F.coalesce("stays", F.lit(0)) - F.col("best.pull")).alias("loss"), "part")
        asks = work.write(asks.filter((F.col("to") != F.col("part")) & (F.col("loss") < 0) & (rand.uniform(seed + i, "vertex") < 0.5)).select("vertex", "to", "loss"), f"asks-{i}")
        if asks.isEmpty():
            if i > 3:
                break
            continue
        placed = work.write(E.ranked(asks, ["to", "loss", "vertex"], "place"), f"placed-{i}")
        first = placed.groupBy("to").agg(F.min("place").alias("first"))
        room = parts.groupBy(F.col("part").alias("to")).agg((F.lit(most) - F.count("*")).alias("room"))  # a row a part, as first
        moves = placed.join(F.broadcast(first), "to").join(F.broadcast(room), "to", "left").filter(F.col("place") - F.col("first") < F.coalesce("room", F.lit(most))).select("vertex", "to")
        parts = work.write(parts.join(moves, "vertex", "left").select("vertex", F.coalesce("to", "part").cast("int").alias("part")), f"part-{i}")
        work.drop(f"part-{i - 1}")
    return parts
