"""Corpus pipeline over documents: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes what the one before kept, read again from Parquet. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars (of the text as it then is).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ngram_join, packing, pii, quality, repeats
from graphloom.llm.common import Workspace, prepare, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows to drop up to which their numbers (8 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000


#: Work tables of the stage before; its result has been written when the next stage begins.
_earlier: list[Workspace] = []


def _stage(function: Stage) -> Stage:
    """A stage over the documents' own columns, which first deletes what the stage before worked with (and nothing else)."""

    @functools.wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        while _earlier:
            _earlier.pop().clear()
        before = list(Workspace.live)
        out = function(spark, docs.select(*COLUMNS), sf_dir)
        _earlier.extend(w for w in Workspace.live if w not in before)
        return out

    return stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, unchanged."""
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word shingles (five words, similarity 0.8) the one of least doc_id; of several with it one."""
    work = Workspace(spark, "survivors")
    # written once: the number depends on the scan's splits, which may differ between passes
    docs = work.write(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = work.write(ngram_join.ngram_classes(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("least")), "groups")
    # what is joined again is written, so that the joins can be split where a group is large
    several = work.write(groups.groupBy("least").agg(F.count("*").alias("size")).filter("size > 1").select("least"), "several")
    members = work.write(docs.select("row", "doc_id").join(groups.join(several, "least"), "row"), "members")
    first = work.write(members.groupBy("least").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "row")).alias("first")), "first")
    gone = work.write(members.join(first, "least").filter("row <> first.row").select("row"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


@_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of passages (50 words or more) that a document of smaller doc_id has too; all rows stay."""
    kept = repeats.remove_repeats(docs, columns=["lang", "source"])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.coalesce(F.length("kept"), F.lit(0)).cast("long").alias("n_chars"))


@_stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with placeholders for personal data, and without terms that disclose it."""
    found = pii.find_personal_data(docs, columns=["lang", "source"])
    return found.select("doc_id", F.col("sanitised").alias("text"), "lang", "source", F.coalesce(F.length("sanitised"), F.lit(0)).cast("long").alias("n_chars"))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of power-of-two length with their token ids (little-endian unsigned 32-bit)."""
    return packing.pack_power_of_two(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express a trained classifier and tokenisers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, results = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = results.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
