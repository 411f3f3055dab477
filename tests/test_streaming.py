"""The stream labels what the batch labels."""

from clickloom.operators.labels import prefix_labels, valid_events
from clickloom.policies import LabelingPolicy
from clickloom.sources.clickstream import clickstream
from clickloom.streaming.labels import stream_labels
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, tmp_path):
    events = clickstream(spark, "/root/testdata/sf0.001").select("user_session", "source_order", "event_time", "event_type")
    last = events.agg(F.max("event_time")).first()[0]
    for i, (low, high) in enumerate(((0, 300), (300, 700), (700, 10**9))):
        events.where(F.col("source_order").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("end", 10**9, last.replace(year=last.year + 1), "view")], events.schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_labels(stream, 360).writeStream.format("memory").queryName("labelled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    found = {(r.user_session, r.source_order): r.label for r in spark.sql("select * from labelled").collect()}
    batch = prefix_labels(clickstream(spark, "/root/testdata/sf0.001"), LabelingPolicy(360))
    assert len(found) == batch.count() and sum(found.values()) == batch.agg(F.sum("label")).first()[0]
    assert valid_events(events).count() >= len(found)
