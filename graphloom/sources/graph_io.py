"""Edge-list files and their relatives: reading with checks, writing, converters, result tables and benchmark logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import edges as E

RESULT = T.StructType(
    [T.StructField("input", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("cores", T.IntegerType()), T.StructField("vertices", T.LongType()), T.StructField("edges", T.LongType()),
     T.StructField("time", T.DoubleType()), T.StructField("trials", T.StringType()), T.StructField("concurrency", T.StringType()), T.StructField("result", T.LongType())]
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): the lines of a file in order; at grows with the place, across splits too (the offset of a split is above its lines' numbers)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace(F.col("value"), r"\r$", "").alias("line"))


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_edge_list(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, int, int]:
    """(edges, n, m) of a file: a free first line and further lines with #, then n and m, then from, to and weight in each line.

    A missing weight is 1, blank lines do not count. With check, another count of rows than m, or an end outside [0, n), raises ValueError.
    """
    # the files of a folder follow each other by name; Spark deals them out by size, so at does not order them
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("place"), F.regexp_replace("value", r"\r$", "").alias("line"))
    filled = lines.filter(F.trim("line") != "")
    free = F.broadcast(filled.agg(F.min("place").alias("free")))
    # the first line that follows the free one and is no comment, however many comments come between
    rest = filled.join(free, F.col("place") > F.col("free")).filter(~F.startswith(F.ltrim("line"), F.lit("#"))).orderBy("place").select("place", "line").limit(1).collect()
    if not rest:
        raise ValueError("no line with the counts of vertices and edges")
    n, m = (int(x) for x in rest[0]["line"].split()[:2])
    f = _fields(F.col("line"))
    header = F.struct(F.lit(rest[0]["place"]["file"]).alias("file"), F.lit(rest[0]["place"]["at"]).cast("long").alias("at"))
    data = filled.filter((F.col("place") > header) & ~F.startswith(F.ltrim("line"), F.lit("#")))
    edges = data.select(F.get(f, F.lit(0)).try_cast("long").alias("src"), F.get(f, F.lit(1)).try_cast("long").alias("dst"), F.when(F.size(f) > 2, F.get(f, F.lit(2))).otherwise(F.lit("1")).try_cast("long").alias("weight"))
    if check:
        bad = (F.col("src") < 0) | (F.col("dst") < 0) | (F.greatest("src", "dst") >= n) | F.col("src").isNull() | F.col("dst").isNull() | F.col("weight").isNull()
        found = edges.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad")).first()
        if found["rows"] != m or found["bad"]:
            raise ValueError(f"{path}: {found['rows']} edges for {m}, {found['bad']} of them with ends outside 0 to {n - 1}")
    return edges, n, m


def write_edge_list(edges: DataFrame, path: str, vertices: int, comment: str = "edge list") -> None:
    """The edge list in one folder: part files in order, the first with the header. Rows are written by range of (src, dst), not by one task."""
    m = edges.count()
    body = edges.select("src", "dst", F.concat_ws(" ", "src", "dst", "weight").alias("value"))
    head = edges.sparkSession.createDataFrame([(-2, 0, f"# {comment}"), (-1, 0, f"{vertices} {m}")], "src long, dst long, value string")
    head.union(body).orderBy("src", "dst").select("value").write.text(path)


def rebased(lines: DataFrame, prefix: str = "a ") -> DataFrame:
    """Edges of lines (at, line) like 'a u v w' with ids from 1, as ids from 0; lines of another kind (comments, problem line) are skipped."""
    f = _fields(F.substring_index("line", prefix, -1))
    rows = lines.filter(F.startswith("line", F.lit(prefix)))
    return rows.select((F.get(f, F.lit(0)).try_cast("long") - 1).alias("src"), (F.get(f, F.lit(1)).try_cast("long") - 1).alias("dst"), F.get(f, F.lit(2)).try_cast("long").alias("weight"))


def read_rebased(spark: SparkSession, path: str) -> DataFrame:
    return rebased(_lines(spark, path))


def normalised(pairs: DataFrame, position: str = "at", keep_loops: bool = False) -> DataFrame:
    """(src, dst, weight 1, at) of pairs (src, dst, at) with ids by first appearance, from 0; loops go, unless kept; ids may be strings (beyond 63 bits)."""
    mapping = E.relabel_first_seen(pairs, position)
    a, b = mapping.toDF("src", "a"), mapping.toDF("dst", "b")
    out = pairs.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).cast("long").alias("weight"), position)
    return out if keep_loops else E.without_loops(out)


def read_snap(spark: SparkSession, path: str, keep_loops: bool = False) -> DataFrame:
    """A pair list with # comments, normalised; ids stay strings until they are numbered, so any length will do."""
    lines = _lines(spark, path).filter((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    f = _fields(F.col("line"))
    return normalised(lines.select(F.get(f, F.lit(0)).alias("src"), F.get(f, F.lit(1)).alias("dst"), "at"), keep_loops=keep_loops)


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Compressed sparse rows as Parquet: vertex, degree, sorted neighbours of both directions."""
    E.adjacency(edges).select("vertex", F.size("neighbours").alias("degree"), "neighbours").write.parquet(path)


def result_line(df: DataFrame, columns: list[str]) -> DataFrame:
    """value: the columns joined by commas, nulls empty, as the result tables hold them."""
    return df.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))


MIN_CUT = ["input", "seed", "p", "n", "m", "time", "comm_time", "trials", "variant", "weight"]
APPROX_CUT = ["input", "seed", "p", "n", "m", "time", "comm_time", "trials", "weight"]
COMPONENTS = ["input", "seed", "p", "n", "m", "time", "comm_time", "kind", "k"]


def write_results(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).option("header", True).option("enforceSchema", True).csv(path)


NOISE = ("slurm", "srun", "[unset]")


def log_records(lines: DataFrame, counters: int = 7) -> DataFrame:
    """(at, line, c0, c1, ...) of a job log's lines (at, line): each result line (that begins with /) with the greatest value of each counter among the PAPI lines after it and before the next.

    Lines with noise of the scheduler are dropped. A result without counters has nulls.
    """
    from pyspark.sql.window import Window

    kept = lines
    for word in NOISE:
        kept = kept.filter(~F.contains("line", F.lit(word)))
    result = F.startswith("line", F.lit("/"))
    # the log's jobs are few; a window over the log as a whole is a window over one file
    group = F.max(F.when(result, F.col("at"))).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    marked = kept.withColumn("record", group).filter("record is not null")
    values = F.split("line", ",")
    most = [F.max(F.when(F.startswith("line", F.lit("PAPI")), F.get(values, F.lit(i + 1)).try_cast("double"))).alias(f"c{i}") for i in range(counters)]
    return marked.groupBy("record").agg(F.max(F.when(result, F.col("line"))).alias("line"), *most).withColumnRenamed("record", "at")


def paired(counters: DataFrame, results: DataFrame) -> DataFrame:
    """(place, counter, line): the n-th counter line beside the n-th result line, of tables (at, line)."""
    a = E.ranked(counters.select("at", F.col("line").alias("counter")), ["at"], "place").drop("at")
    b = E.ranked(results.select("at", "line"), ["at"], "place").drop("at")
    return a.join(b, "place")


def harvest(spark: SparkSession, pattern: str, counters: int = 7) -> DataFrame:
    """The records of all logs that match a pattern, with their file; each file is read on its own."""
    from pyspark.sql.window import Window

    lines = spark.read.text(pattern).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    for word in NOISE:
        lines = lines.filter(~F.contains("line", F.lit(word)))
    result = F.startswith("line", F.lit("/"))
    lines = lines.withColumn("record", F.max(F.when(result, F.col("at"))).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).filter("record is not null")
    values = F.split("line", ",")
    most = [F.max(F.when(F.startswith("line", F.lit("PAPI")), F.get(values, F.lit(i + 1)).try_cast("double"))).alias(f"c{i}") for i in range(counters)]
    return lines.groupBy("file", "record").agg(F.max(F.when(result, F.col("line"))).alias("line"), *most).drop("record")
