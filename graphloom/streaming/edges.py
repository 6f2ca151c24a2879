"""Streams of edges: counts by event-time window, and incremental components.

These are extensions; nothing in the batch engine needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import connected_components
from ..session import Workspace, prepare


def window_counts(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(start, event_type, n, users) of events (ts, event_type, user_id), batch or stream: by window of event time; a stream drops what is later than lateness. users is exact for a batch, approximate for a stream."""
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "users")


class IncrementalComponents:
    """(vertex, component) of all edges seen so far. Each micro-batch joins its edges to the labels of their ends only, so its cost follows the batch and the components it joins, not the history."""

    def __init__(self, spark: SparkSession) -> None:
        self.work = Workspace(prepare(spark), "incremental")
        self.labels = self.work.write(spark.createDataFrame([], "vertex long, component long"), "labels-start")

    def add(self, edges: DataFrame, batch: int) -> None:
        """Take in a batch of edges (src, dst). A batch that is given again changes nothing."""
        known = self.labels
        roots = edges.join(known.toDF("src", "a"), "src", "left").join(known.toDF("dst", "b"), "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
        moved = connected_components(roots).toDF("old", "new")
        fresh = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().join(known, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
        everyone = known.union(fresh)
        after = everyone.join(moved, everyone["component"] == moved["old"], "left").select("vertex", F.coalesce("new", "component").alias("component"))
        self.labels = self.work.write(after, f"labels-{batch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in a stream of edges until it is stopped or, with the source's end, done."""
        return stream.writeStream.foreachBatch(lambda df, batch: self.add(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
