"""Statistics of measurements: medians with rank-based confidence intervals, trends, speed-up."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def median_interval(df: DataFrame, group: list[str], value: str, p: float = 0.05) -> DataFrame:
    """By group: observations, median, ci_lo, ci_hi (order statistics that bound the median at confidence 1 - p; null for too few values), ci_mean_ratio.

    Null values are left out. Ranks come from an exact percentile of the group's distinct values, not from a sorted list.
    """
    z = NormalDist().inv_cdf(1 - p / 2)
    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(*group).agg(F.count(value).alias("observations"), F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"))
    n = F.col("observations")
    lo, hi = F.floor((n - z * F.sqrt(n)) / 2), F.floor(1 + (n + z * F.sqrt(n)) / 2)
    enough = (lo >= 1) & (hi <= n)
    # the k-th smallest value, by running counts over distinct values
    tally = rows.groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*group).orderBy("v"))
    placed = tally.withColumn("upto", upto).join(counts.select(*group, F.when(enough, lo).alias("lo"), F.when(enough, hi).alias("hi")), group)
    ends = placed.groupBy(*group).agg(F.min(F.when(F.col("upto") >= F.col("lo"), F.col("v"))).alias("ci_lo"), F.min(F.when(F.col("upto") >= F.col("hi"), F.col("v"))).alias("ci_hi"))
    return counts.join(ends, group).select(*group, "observations", "median", "ci_lo", "ci_hi", ((F.col("ci_hi") - F.col("ci_lo")) / F.col("mean")).alias("ci_mean_ratio"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope and intercept of the least-squares line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def speedup(df: DataFrame, cores: str, time: str) -> DataFrame:
    """Each row's speed-up over the row of fewest cores, and the ideal one; the reference row is one broadcast row."""
    base = df.agg(F.min_by(time, cores).alias("base_time"), F.min(cores).alias("base_cores"))
    return df.join(F.broadcast(base)).select(df["*"], (F.col("base_time") / F.col(time)).alias("speedup"), (F.col(cores) / F.col("base_cores")).alias("ideal"))


def job_grid(spark: SparkSession, inputs: list[str], cores: list[int], repetitions: int) -> DataFrame:
    """(input, cores, repetition, seed): every run of an experiment, each with a seed of its own."""
    runs = spark.createDataFrame([(i, name) for i, name in enumerate(inputs)], "place int, input string").withColumn("cores", F.explode(F.array(*map(F.lit, cores)))).withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    return runs.select("input", "cores", "repetition", (F.col("place") * repetitions + F.col("repetition")).alias("seed"))
