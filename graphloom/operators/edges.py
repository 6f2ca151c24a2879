"""Building blocks over edge tables (src, dst, weight): all are declarative plans without Python code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import Workspace, prepare

EDGE = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("weight", T.LongType(), False)])


def canonical(edges: DataFrame) -> DataFrame:
    """Each edge from its smaller to its greater end."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def merged(edges: DataFrame) -> DataFrame:
    """Parallel edges in either direction as one of their summed weight; loops dropped."""
    return canonical(without_loops(edges)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def merged_by(edges: DataFrame, keys: list[str]) -> DataFrame:
    """As merged, separately for each value of keys."""
    return canonical(without_loops(edges)).groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("weight"))


def least_scores(edges: DataFrame) -> DataFrame:
    """Parallel scored edges (src, dst, score) as one with the least score."""
    return canonical(without_loops(edges)).groupBy("src", "dst").agg(F.min("score").alias("score"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    names = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *names).union(edges.select("dst", "src", *names))


def transposed(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def triangular(edges: DataFrame) -> DataFrame:
    """The edges from smaller to greater ends."""
    return edges.filter("src < dst")


def heavy(edges: DataFrame, bound: int | Column) -> DataFrame:
    return edges.filter(F.col("weight") >= bound)


def cleaned(edges: DataFrame) -> DataFrame:
    """Without loops and repeated edges (the first kept is the lightest)."""
    return without_loops(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    """The distinct endpoints."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def max_vertex(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_vertex"))


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, degree, weight): edge ends and their weight at each endpoint; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex"), "weight")
    return ends.groupBy("vertex").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("vertices"))


def least_degree(edges: DataFrame) -> DataFrame:
    """The least weighted degree: an upper bound of the minimum cut."""
    return degrees(without_loops(edges)).agg(F.min("weight").alias("bound"))


def without_hubs(edges: DataFrame, most: int) -> DataFrame:
    """Without the edges at vertices of more than most ends."""
    hubs = degrees(edges).filter(F.col("degree") > most).select("vertex")
    return edges.join(hubs, edges["src"] == hubs["vertex"], "left_anti").join(hubs, edges["dst"] == hubs["vertex"], "left_anti")


def relabel(edges: DataFrame, mapping: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Endpoints replaced by mapping(old, new); an end that is not in it stays. A map whose size the planner knows to be small is broadcast by it, else the joins are by sort and can be split."""
    first = mapping.select(F.col(old).alias("src"), F.col(new).alias("__src"))
    second = mapping.select(F.col(old).alias("dst"), F.col(new).alias("__dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(first, "src", "left").join(second, "dst", "left").select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst"), *rest)


def contracted(edges: DataFrame, mapping: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """The graph in which the vertices of equal label are one: relabelled, loops dropped, parallel edges summed."""
    return merged(relabel(edges, mapping, old, new))


def composed(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """labels (vertex, component) with component replaced by mapping (old, new)."""
    return labels.join(mapping, labels["component"] == mapping["old"], "left").select("vertex", F.coalesce("new", "component").alias("component"))


def crossing(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """The edges whose ends lie on different sides by sides (vertex, side)."""
    a, b = sides.select(F.col("vertex").alias("src"), F.col("side").alias("a")), sides.select(F.col("vertex").alias("dst"), F.col("side").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a <> b").select(*edges.columns)


def cut_value(edges: DataFrame, sides: DataFrame) -> DataFrame:
    return crossing(edges, sides).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("cut_value"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(vertex, neighbours): each vertex's sorted array of (dst, weight) over both directions."""
    return symmetric(edges).groupBy(F.col("src").alias("vertex")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def relabel_by_neighbour_degree(edges: DataFrame) -> DataFrame:
    """(old, new): vertices ranked by the greatest degree among their neighbours, then their own id."""
    d = degrees(edges).select("vertex", "degree")
    best = symmetric(edges).join(d, F.col("dst") == F.col("vertex")).groupBy("src").agg(F.max("degree").alias("best"))
    return ranked(best.select(F.col("src").alias("old"), (-F.col("best")).alias("key")), ["key", "old"])


def _dealt(df: DataFrame, order: list[str], shards: int, value: F.Column) -> DataFrame:
    """df by range partitions of order, with __part and, within it, the running __run of value up to each row; written, as another run would draw other bounds."""
    work = Workspace(prepare(df.sparkSession), "ranges")
    ranges = df.repartitionByRange(max(1, shards), *order).withColumn("__part", F.spark_partition_id())
    return work.write(ranges.withColumn("__run", F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))), "dealt")


def _before(dealt: DataFrame, total: F.Column) -> DataFrame:
    """(__part, __before): the totals of the ranges before each; a row a range, and so a window over few rows."""
    totals = dealt.groupBy("__part").agg(total.alias("__n"))
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(totals.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before")))


def ranked(df: DataFrame, order: list[str], name: str = "new", shards: int = 64) -> DataFrame:
    """df with name: its place, from 0, in the order of columns - by range partitions and their sizes, so that no task holds all rows.

    Rows of equal order share a range partition and take places in any order among themselves, so order should be unique.
    """
    dealt = _dealt(df, order, shards, F.lit(1))
    return dealt.join(_before(dealt, F.count("*")), "__part").withColumn(name, F.col("__run") + F.col("__before") - 1).drop("__part", "__run", "__before")


def dense_labels(labels: DataFrame, label: str = "component") -> DataFrame:
    """labels with dense: the rank, from 0, of their label among the distinct ones."""
    return labels.join(ranked(labels.select(label).distinct(), [label], "dense"), label)


def relabel_sorted(edges: DataFrame) -> DataFrame:
    """(old, new): endpoints by ascending id, from 0."""
    return ranked(vertices(edges).toDF("old"), ["old"])


def relabel_first_seen(edges: DataFrame, position: str) -> DataFrame:
    """(old, new): endpoints in the order of their first place in the table (source before destination), from 0; position orders the rows."""
    seen = edges.select(F.explode(F.array(F.struct(F.col("src").alias("old"), (F.col(position) * 2).alias("at")), F.struct(F.col("dst").alias("old"), (F.col(position) * 2 + 1).alias("at")))).alias("end")).groupBy("end.old").agg(F.min("end.at").alias("at"))
    return ranked(seen.select("old", "at"), ["at"]).select("old", "new")


def prefix_sums(df: DataFrame, order: str, value: str, exclusive: bool = True, shards: int = 64) -> DataFrame:
    """df with offset: the sum of value over the rows before (and, unless exclusive, of) each; by range partitions and their totals. order must be unique."""
    dealt = _dealt(df, [order], shards, F.col(value))
    out = dealt.join(_before(dealt, F.sum(value)), "__part")
    return out.withColumn("offset", F.col("__run") + F.col("__before") - (F.col(value) if exclusive else 0)).drop("__part", "__run", "__before")


def prefix_sums_by(df: DataFrame, order: list[str], value: str, shards: int = 64) -> DataFrame:
    """df with offset, the sum of value over the rows before, in the order of columns (equal rows in any order), and __part, the range of rows it lies in."""
    dealt = _dealt(df, order, shards, F.col(value))
    return dealt.join(_before(dealt, F.sum(value)), "__part").withColumn("offset", F.col("__run") + F.col("__before") - F.col(value)).drop("__run", "__before")


def block_totals(edges: DataFrame, rows: int) -> DataFrame:
    """(block, edges, weight) of each block of so many consecutive source vertices, the unit in which a matrix's rows are dealt out."""
    return edges.groupBy(F.floor(F.col("src") / rows).alias("block")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def partition_totals(edges: DataFrame) -> DataFrame:
    """(partition, edges, weight) of each partition in which the edges lie: a diagnostic of their distribution."""
    return edges.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def sortedness(df: DataFrame, order: list[str]) -> DataFrame:
    """(inversions): rows that come before their predecessor in a globally sorted and partitioned copy; 0 for a right sort."""
    ordered = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    key = F.struct(*order)
    within = F.lag(key).over(Window.partitionBy(F.shiftright("__id", 33)).orderBy("__id"))
    inside = ordered.select(F.shiftright("__id", 33).alias("__part"), key.alias("__key"), within.alias("__last"))
    inner = inside.agg(F.coalesce(F.sum(F.when(F.col("__key") < F.col("__last"), 1).otherwise(0)), F.lit(0)).alias("a"))
    ends = inside.groupBy("__part").agg(F.min("__key").alias("low"), F.max("__key").alias("high"))  # a row a partition
    outer = ends.withColumn("__last", F.lag("high").over(Window.orderBy("__part"))).agg(F.coalesce(F.sum(F.when(F.col("low") < F.col("__last"), 1).otherwise(0)), F.lit(0)).alias("b"))
    return inner.join(F.broadcast(outer)).select((F.col("a") + F.col("b")).alias("inversions"))


def orphans(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Endpoints that are not among known (vertex)."""
    return vertices(edges).join(known, "vertex", "left_anti")


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, loops, weight, least, greatest and mean degree."""
    d = degrees(edges).agg(F.count("*").alias("vertices"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    e = edges.agg(F.count("*").alias("edges"), F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("loops"), F.sum("weight").alias("weight"))
    return d.join(F.broadcast(e))
