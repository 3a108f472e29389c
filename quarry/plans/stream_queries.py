"""Streams over the events table; each is worked off into a table in the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import registry
from quarry.session import shared_folder, shared_path
from quarry.streaming import streams


def _available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    streams.run_available(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _complete(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    last = streams.run_complete(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(last) if last else spark.createDataFrame([], stream.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = streams.file_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(name: str, sql: str | None):
    def register(f):
        registry.QUERIES[name] = lambda spark, sf_dir: f(spark, _events(spark, sf_dir))
        if sql:
            registry.ORACLES[name] = sql
        return f

    return register


@_stream("stream_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def _(spark, events):
    found = streams.dedup(events.select("event_id", "user_id", "ts"), ["event_id"], "ts", "60 days")
    return _available(spark, found, "dedup").select("event_id", "user_id")


@_stream("stream_change_feed", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def _(spark, events):
    found = streams.change_feed(events.withColumn("entity_type", F.col("event_type")), "click")
    return _available(spark, found.select("event_id", "user_id"), "feed")


def _days(counts: DataFrame) -> DataFrame:
    return counts.withColumn("start", F.col("start").cast("date"))


# windows begin at whole days from 1970-01-01 on
@_stream("stream_tumbling_counts", "SELECT (DATE '1970-01-01' + (datediff('day', DATE '1970-01-01', ts::DATE) // 7 * 7)::INT)::DATE AS start, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")
def _(spark, events):
    return _days(_complete(spark, streams.tumbling_counts(events, "ts", "7 days", ["event_type"], late=None), "tumbling"))


@_stream("stream_sliding_counts", "SELECT (ts::DATE - i::INT)::DATE AS start, event_type, count(*) AS cnt FROM events, range(7) r(i) GROUP BY 1, 2")
def _(spark, events):
    return _days(_complete(spark, streams.sliding_counts(events, "ts", "7 days", "1 day", ["event_type"], late=None), "sliding"))


@registry.query("stream_two_keys", "SELECT DISTINCT md5(text) AS title FROM documents")
def _(t):
    """Documents by id and title over micro-batches (Z2), a title being what stays whatever the order of the files."""
    docs = t("documents")
    spark, schema = docs.sparkSession, docs.select("doc_id", F.lit("").alias("title"), F.lit(0).cast("long").alias("rank")).schema
    rows = streams.file_stream(spark, docs.inputFiles()[0].rsplit("/documents.parquet", 1)[0] + "/documents.parquet*", docs.schema)
    rows = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("title"), F.col("doc_id").alias("rank"))
    root = shared_path(spark, "two-keys")
    kept = streams.KeyedDedup(spark, root, schema, "doc_id", "title", "rank")
    streams.run_batches(rows, kept, f"{root}/checkpoint").awaitTermination()
    return kept.rows().select("title")
