"""The windowed streams against a batch count of the same windows."""

import pytest
from pyspark.sql import functions as F

from quarry.plans import registry
from quarry.streaming import streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((str(r["start"]), str(r["event_type"]), r["cnt"]) for r in df.collect())


def batch(events, *window):
    return rows(events.groupBy(F.window("ts", *window).alias("w"), "event_type").agg(F.count("*").alias("cnt")).select("w.start", "event_type", "cnt"))


@pytest.mark.parametrize(("name", "window"), [("stream_tumbling_counts", ("7 days",)), ("stream_sliding_counts", ("7 days", "1 day"))])
def test_every_window(spark, name, window):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(registry.QUERIES[name](spark, SF)) == [(start[:10], kind, n) for start, kind, n in batch(events, *window)]


def test_late_files_count(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (events.where("ts >= '2024-01-15'"), events.where("ts < '2024-01-15'")):  # the later rows arrive first
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.file_stream(spark, f"{tmp_path}/in", events.schema, files_per_trigger=1)
    last = streams.run_complete(streams.tumbling_counts(stream, "ts", "7 days", ["event_type"], late=None), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert rows(spark.read.parquet(last)) == batch(events, "7 days")
