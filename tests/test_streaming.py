"""The streaming extensions against the batch results."""

from graphloom.operators.components import connected_components
from graphloom.streaming.edges import IncrementalComponents, window_counts


def test_incremental_components(spark, tmp_path):
    batches = [[(1, 2), (3, 4)], [(2, 3), (9, 9)], [(5, 6), (6, 4), (7, 8)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    state = IncrementalComponents(spark)
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state.start(stream, f"{tmp_path}/checkpoint").awaitTermination()
    want = connected_components(spark.createDataFrame(sum(batches, []), "src long, dst long"))
    assert sorted(map(tuple, state.labels.collect())) == sorted(map(tuple, want.collect()))


def test_window_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {(r.start, r.event_type): r.n for r in window_counts(events).collect()}
    assert sum(batch.values()) == events.count()
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    window_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.start, r.event_type): r.n for r in spark.sql("select * from counts").collect()} == batch
