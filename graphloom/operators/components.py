"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace, prepare
from .kernels import component_labels, dense_ids


def _large_star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Join each vertex's larger neighbours to the least of itself and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    # written, so that the join stands on two plain exchanges, of which adaptive execution can split a hub's
    least = work.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Join each vertex and its smaller neighbours to the least of these; edges run from the greater to the smaller end."""
    least = work.write(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", "m"))


def _in_one_task(ends: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, names = dense_ids(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"vertex": names, "component": names[component_labels(len(names), a, b)]})

    return ends.groupBy(F.lit(0).alias("all")).applyInPandas(run, "vertex long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, kernel_edges: int = 0) -> DataFrame:
    """(vertex, component): for every endpoint of an edge the least vertex of its component.

    Loops, parallel edges and rows in either direction change nothing; rows with a null
    endpoint are left out; no edges give no rows. A graph of kernel_edges distinct edges or fewer, which are counted, is
    worked off in one task. For others every round cuts lineage by a written
    table in the shared folder; the number of rounds grows with the logarithm of the
    longest path. Joins on a hub's rows can be split by adaptive execution.
    """
    spark = prepare(edges.sparkSession)
    work = Workspace(spark, "components")
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    ends = work.write(edges.filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "ends")
    if kernel_edges and ends.count() <= kernel_edges:
        return _in_one_task(ends)
    vertices = ends.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    now = ends.filter("u <> v")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = print_of(now)
    for i in range(1, max_rounds + 1):
        if not mark[0]:
            break
        star = _large_star(now, work, f"least-{i}").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        star = work.write(star.distinct(), f"star-{i}")
        after = work.write(_small_star(star, work, f"small-{i}").distinct(), f"edges-{i}")
        for name in (f"edges-{i - 1}", f"least-{i}", f"star-{i}", f"small-{i}"):
            work.drop(name)
        was, mark, now = mark, print_of(after), after
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return vertices.join(now.toDF("vertex", "least"), "vertex", "left").select("vertex", F.coalesce("least", "vertex").alias("component"))


#: Edges (16 bytes each) up to which one task is faster than rounds of joins.
KERNEL_EDGES = 1_000_000


def small_or_large(edges: DataFrame, src: str = "src", dst: str = "dst", kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """connected_components, in one task where the graph is small."""
    return connected_components(edges, src, dst, kernel_edges=kernel_edges)
