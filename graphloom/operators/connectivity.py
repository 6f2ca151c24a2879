"""Connectivity reports over components: labels of all vertices, sizes, tests, repair, and components by iterated sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rand, theory
from ..session import Workspace, prepare
from . import edges as E
from .components import small_or_large as connected_components
from .kernels import component_labels, dense_ids

#: Edges that a round of iterated sampling hands to the driver at most (16 bytes each).
SAMPLE_EDGES = 1_000_000


def labels(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(vertex, component) for all endpoints and, if given, all vertices (vertex): isolated ones are their own component."""
    found = connected_components(edges)
    if vertices is None:
        return found
    return vertices.select("vertex").distinct().join(found, "vertex", "full").select("vertex", F.coalesce("component", "vertex").alias("component"))


def divided_components(edges: DataFrame, parts: int = 2, kernel_edges: int | None = None) -> DataFrame:
    """The same labels as connected_components(), by dividing the edges into parts, labelling each, and joining the labels: each vertex's labels of the parts are linked with it."""
    work = Workspace(prepare(edges.sparkSession), "divided")
    find = connected_components if kernel_edges is None else (lambda e: connected_components(e, kernel_edges=kernel_edges))
    ends = work.write(E.canonical(edges.select("src", "dst")).distinct().withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(parts))), "ends")
    stars: DataFrame | None = None
    for part in range(parts):
        found = work.write(find(ends.filter(F.col("part") == part).select("src", "dst")), f"labels-{part}")
        stars = found if stars is None else stars.union(found)
    return find(stars.toDF("src", "dst"))


def sampled_components(edges: DataFrame, vertices: DataFrame | None = None, seed: int = 0, sample_edges: int = SAMPLE_EDGES, weight: str | None = None) -> DataFrame:
    """The same labels as labels(), by iterated sparse sampling; with weight (a column of positive numbers) heavier edges are sampled first.

    Each round draws a sample of some n^(1 + e/2) edges, at most sample_edges, finds its components in one place, and relabels
    the rest by the map of what the sample joined. When a round's sample would no longer shrink the graph fast (or
    what is left fits into the sample) the rest is worked off: by the kernel, if it fits, else by star contraction. The map that is broadcast has two rows a sampled edge at most.
    """
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "sampling")
    merge = lambda e: E.without_loops(E.canonical(e)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    rest = work.write(merge(edges.select("src", "dst", (F.lit(1) if weight is None else F.col(weight)).cast("double").alias("weight"))), "edges-0")
    everyone = E.vertices(edges) if vertices is None else E.vertices(edges).union(vertices.select("vertex")).distinct()
    current = work.write(everyone.select("vertex", F.col("vertex").alias("component")), "labels-0")
    n = current.count()
    for i in range(1, 40):
        m = rest.count()
        if not m:
            return current
        size = min(theory.sample_size_unweighted(max(n, 2), m), sample_edges)
        if i > 12:  # sampling no longer pays
            mapping = connected_components(rest).toDF("old", "new")
        else:
            # the least exponential scores are a sample by weight, the least uniform values one without
            score = rand.uniform(seed + i, "src", "dst") if weight is None else rand.exponential(F.col("weight"), seed + i, "src", "dst")
            sample = rest if m <= size else rest.orderBy(score, "src", "dst").limit(size)
            table = sample.select("src", "dst").toArrow()
            a, b, names = dense_ids(table.column("src").to_numpy(), table.column("dst").to_numpy())
            found = names[component_labels(len(names), a, b)]
            moved = found != names
            mapping = F.broadcast(spark.createDataFrame(pd.DataFrame({"old": names[moved], "new": found[moved]}), "old long, new long")) if moved.any() else None
        if mapping is not None:
            current = work.write(E.composed(current, mapping), f"labels-{i}")
            rest = work.write(merge(E.relabel(rest, mapping)), f"edges-{i}")
        n = max(2, n - int(np.sum(moved)) if i <= 12 else n)
    raise RuntimeError("components did not settle")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("size"))


def component_count(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.countDistinct("component").alias("components"))


def largest_component(labelled: DataFrame) -> DataFrame:
    """(component, size) of the largest, of equal ones the least label."""
    sizes = component_sizes(labelled)
    best = F.max(F.struct(F.col("size"), (-F.col("component")).alias("least")))
    return sizes.agg(best.alias("best")).select((-F.col("best.least")).alias("component"), F.col("best.size").alias("size")).filter("size is not null")


def is_connected(labelled: DataFrame) -> DataFrame:
    return labelled.agg((F.min("component").eqNullSafe(F.max("component"))).alias("connected"))


def repaired(edges: DataFrame, labelled: DataFrame, seed: int = 0, weight: int = 5000) -> DataFrame:
    """The edges without loops, and an edge of the given weight from each vertex outside the largest component to a member of it.

    Which member is a hash of the vertex and seed, uniform over the component.
    """
    top = largest_component(labelled)
    members = E.ranked(labelled.join(F.broadcast(top), "component").select("vertex"), ["vertex"], "place")
    outside = labelled.join(F.broadcast(top.select(F.col("component").alias("main"), "size"))).filter("component <> main")
    chosen = outside.select("vertex", F.floor(rand.uniform(seed, "vertex") * F.col("size")).alias("place"))
    bridges = chosen.join(members.toDF("member", "place"), "place").select(F.col("vertex").alias("src"), F.col("member").alias("dst"), F.lit(weight).cast("long").alias("weight"))
    return E.without_loops(edges.select("src", "dst", "weight")).union(bridges)
