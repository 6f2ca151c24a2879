"""Samples of edges whose choice depends on a seed and the edge only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rand
from ..session import Workspace, prepare
from .edges import prefix_sums_by


def uniform_sample(edges: DataFrame, rate: float, seed: int, *keys: str) -> DataFrame:
    """Each edge with the given probability, independently."""
    return edges.filter(rand.uniform(seed, *(keys or ("src", "dst"))) < rate)


def scored(edges: DataFrame, seed: int, *keys: str) -> DataFrame:
    """edges with score: exponential of rate weight, so that ascending scores are a weighted order without replacement. Weights must be positive."""
    return edges.withColumn("score", rand.exponential(F.col("weight"), seed, *(keys or ("src", "dst"))))


def weighted_sample(edges: DataFrame, size: int, seed: int, *keys: str) -> DataFrame:
    """size edges drawn by weight without replacement, in the order of their scores (top-k per partition first, then merged)."""
    return scored(edges, seed, *keys).orderBy("score", "src", "dst").limit(size)


def with_replacement(edges: DataFrame, size: int, seed: int, weight: str | None = None, shards: int = 64) -> DataFrame:
    """(draw, src, dst, weight): size independent draws, each edge equally likely or, with weight, in proportion to that column (integers; those below 1 are never drawn). In the order of draw, from 0.

    A draw is a point on the line of all weights laid end to end. Ranges of edges and their totals say which range it falls
    into, and a merge of points and edges there finds the edge, so neither is in one task. No edges give no draws.
    """
    value = F.lit(1).cast("long") if weight is None else F.greatest(F.col(weight).cast("long"), F.lit(0))
    lots = edges.select("src", "dst", "weight", value.alias("__value")).filter("__value > 0")
    line = prefix_sums_by(lots, ["src", "dst", "weight"], "__value", shards)
    work = Workspace(prepare(edges.sparkSession), "draws")
    line = work.write(line.select("__part", F.col("offset").alias("at"), F.struct("src", "dst", "weight").alias("edge"), "__value"), "line")
    ranges = line.groupBy("__part").agg(F.min("at").alias("low"), F.max(F.col("at") + F.col("__value")).alias("high"))  # a row a range
    total = line.agg(F.max(F.col("at") + F.col("__value")).alias("total"))
    draws = edges.sparkSession.range(size).join(F.broadcast(total)).select(F.col("id").alias("draw"), F.floor(rand.uniform(seed, "id") * F.col("total")).alias("at")).filter("at is not null")
    placed = draws.join(F.broadcast(ranges), (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("__part", "at", F.lit(None).cast(line.schema["edge"].dataType).alias("edge"), "draw")
    both = line.select("__part", "at", "edge", F.lit(None).cast("long").alias("draw")).union(placed)
    before = Window.partitionBy("__part").orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("edge", F.last("edge", ignorenulls=True).over(before)).filter("draw is not null").select("draw", "edge.*")


def thinned(edges: DataFrame, level: Column, seed: int, *keys: Column | str) -> DataFrame:
    """The edges of which at least one of weight copies survives a coin of 2**-level."""
    return edges.filter(rand.survives(F.col("weight"), level, seed, "src", "dst", *keys))


def median_split(edges: DataFrame) -> DataFrame:
    """Scored edges with first: whether the score is at most the median score (exact percentile)."""
    middle = edges.agg(F.percentile("score", F.lit(0.5)).alias("middle"))
    return edges.join(F.broadcast(middle)).withColumn("first", F.col("score") <= F.col("middle")).drop("middle")


def pick_member(members: DataFrame, group: str, member: str, seed: int) -> DataFrame:
    """(group, picked): one member of each group, uniformly: the one of least hash."""
    return members.groupBy(group).agg(F.min_by(member, F.struct(rand.uniform(seed, member), F.col(member))).alias("picked"))
