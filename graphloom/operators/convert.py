"""Graph conversions: overlays, weights, orders and partitions of edge tables, and in- and out-degree histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rand
from . import edges as E


def with_random_weights(edges: DataFrame, low: int, high: int, seed: int = 0) -> DataFrame:
    """Weights uniform in [low, high], by a hash of the ends, the same for both directions of an edge."""
    return edges.withColumn("weight", rand.uniform_int(low, high, seed, F.least("src", "dst"), F.greatest("src", "dst")))


def with_constant_weight(edges: DataFrame, weight: int) -> DataFrame:
    return edges.withColumn("weight", F.lit(weight).cast("long"))


def with_ring(edges: DataFrame, n: int, weight: int = 1) -> DataFrame:
    """The edges and a ring over the vertices 0 to n - 1, which makes the graph connected."""
    ring = edges.sparkSession.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(weight).cast("long").alias("weight"))
    return edges.select("src", "dst", "weight").union(ring)


def with_tree(edges: DataFrame, n: int, weight: int = 1) -> DataFrame:
    """The edges and a complete binary tree over the vertices 0 to n - 1."""
    tree = edges.sparkSession.range(1, max(n, 1)).select(F.floor((F.col("id") - 1) / 2).alias("src"), F.col("id").alias("dst"), F.lit(weight).cast("long").alias("weight"))
    return edges.select("src", "dst", "weight").union(tree)


def ordered(edges: DataFrame, by: str = "dst") -> DataFrame:
    """The edges in a global order of src, then by (dst or weight), as a range-partitioned sort."""
    return edges.orderBy("src", by, *(c for c in ("dst", "weight") if c != by))


def partitioned(edges: DataFrame, by: str, parts: int, path: str) -> None:
    """The edges as Parquet in folders part=0 to parts - 1 by a hash of src or dst."""
    edges.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).repartition(parts, "part").write.partitionBy("part").parquet(path)


def directed_degrees(edges: DataFrame) -> DataFrame:
    """(vertex, out, in) of directed edges, of all endpoints."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    return ends.groupBy("e.vertex").agg(F.sum("e.out").alias("out"), F.sum("e.in").alias("in"))


def directed_histogram(edges: DataFrame, side: str = "in") -> DataFrame:
    """(degree, vertices) by in- or out-degree."""
    return directed_degrees(edges).groupBy(F.col(side).alias("degree")).agg(F.count("*").alias("vertices"))


def offset_histogram(edges: DataFrame, width: int) -> DataFrame:
    """(bucket, edges): how far apart the ends' numbers are, in buckets of width."""
    return edges.groupBy(F.floor(F.abs(F.col("src") - F.col("dst")) / width).alias("bucket")).agg(F.count("*").alias("edges"))


def disjoint_union(graphs: list[DataFrame], n: int) -> DataFrame:
    """Graphs of n vertices each side by side: the i-th graph's vertices are shifted by i * n."""
    out: DataFrame | None = None
    for i, g in enumerate(graphs):
        moved = g.select((F.col("src") + i * n).alias("src"), (F.col("dst") + i * n).alias("dst"), "weight")
        out = moved if out is None else out.union(moved)
    if out is None:
        raise ValueError("no graphs")
    return out


def cleaned_simple(edges: DataFrame) -> DataFrame:
    """A simple undirected graph: canonical, without loops and repetitions."""
    return E.cleaned(E.canonical(edges))
