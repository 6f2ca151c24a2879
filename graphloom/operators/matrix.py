"""Matrices in long form (row, col, value): cells that are not stored are zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import merged


def from_edges(edges: DataFrame) -> DataFrame:
    """The symmetric matrix of a graph: both cells of each merged edge."""
    m = merged(edges)
    return m.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")).union(m.select("dst", "src", "weight"))


def to_edges(matrix: DataFrame, both: bool = False) -> DataFrame:
    """The nonzero cells as edges: both directions, or the lower triangle with the diagonal."""
    cells = matrix.filter("value <> 0")
    return (cells if both else cells.filter("row >= col")).select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Cells of rows (row, values: array)."""
    return rows.select("row", F.posexplode("values").alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), "value").filter("value <> 0")


def to_rows(matrix: DataFrame, n: int) -> DataFrame:
    """(row, values): dense rows of length n, of rows with a cell."""
    cells = matrix.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))
    return cells.select("row", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.element_at("cells", j.cast("long")), F.lit(0).cast("long"))).alias("values"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def zero_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.filter("row <> col")


def asymmetries(matrix: DataFrame) -> DataFrame:
    """Cells that differ from their mirror image; none for a symmetric matrix."""
    a = matrix.filter("value <> 0")
    both = a.select("row", "col", "value").union(a.select("col", "row", -F.col("value")))
    return both.groupBy("row", "col").agg(F.sum("value").alias("difference")).filter("difference <> 0")


def is_symmetric(matrix: DataFrame) -> DataFrame:
    return asymmetries(matrix).agg((F.count("*") == 0).alias("symmetric"))


def combined(matrix: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows and columns replaced by mapping (old, new), cells added up, diagonal dropped: a contraction."""
    a, b = mapping.toDF("row", "__r"), mapping.toDF("col", "__c")
    moved = matrix.join(a, "row", "left").join(b, "col", "left").select(F.coalesce("__r", "row").alias("row"), F.coalesce("__c", "col").alias("col"), "value")
    return zero_diagonal(moved).groupBy("row", "col").agg(F.sum("value").alias("value"))


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("row").agg(F.sum("value").alias("value"))


def total(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.sum("value").alias("value"))


def row(matrix: DataFrame, i: int) -> DataFrame:
    return matrix.filter(F.col("row") == i)
