"""Structured Streaming forms of the windowed, deduplicating and change-feed operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarry.operators.entities import dedup_documents
from quarry.session import delete_folder
from quarry.sources.committed import CommittedTable


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Arriving Parquet files as micro-batches (Z1, Z6); the checkpoint keeps the place."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, time: str, width: str, by: list[str], late: str | None = "2 days") -> DataFrame:
    """Counts by event-time window; rows later than the watermark no longer count, with late=None all do."""
    return _window_counts(events, time, F.window(time, width), by, late)


def sliding_counts(events: DataFrame, time: str, width: str, slide: str, by: list[str], late: str | None = "2 days") -> DataFrame:
    return _window_counts(events, time, F.window(time, width, slide), by, late)


def _window_counts(events: DataFrame, time: str, window: Column, by: list[str], late: str | None) -> DataFrame:
    kept = events if late is None else events.withWatermark(time, late)
    return kept.groupBy(window.alias("w"), *by).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), *by, "cnt")


def dedup(events: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def change_feed(log: DataFrame, entity_type: str) -> DataFrame:
    return log.where(F.col("entity_type") == entity_type)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Work off all that has arrived into a Parquet table, exactly once, and stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()


def run_complete(stream: DataFrame, sink: str, checkpoint: str) -> str | None:
    """Work off all that has arrived; every batch writes the whole result to a folder of its own, and the last one's is returned (None without a batch).

    No window is held back for later rows. A batch that is repeated overwrites its own folder; the folder of the batch before is deleted."""
    written: list[int] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id:012d}")
        if written:
            delete_folder(batch.sparkSession, f"{sink}/batch={written[-1]:012d}")
        written.append(batch_id)

    stream.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return f"{sink}/batch={max(written):012d}" if written else None


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Call each(batch, batch_id) for every micro-batch (Z1, Z7, Z8); an idempotent sink makes it exactly once."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


class KeyedDedup:
    """The rule of dedup_documents over micro-batches (Z2): a row is kept if neither its id nor its title is that of a row kept before.

    A batch's rows are held against the keys kept so far and then among themselves, by rank; ranks have to rise from batch to batch for the result to be that
    of all rows at once. The keys are a CommittedTable, of which a batch reads and rewrites the buckets of its own keys. A batch's rows are written to a folder of
    its own before its keys are committed, and count once that is done: a batch that was lost is repeated, one that was committed is passed over."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, id_column: str, title_column: str, rank: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.names = id_column, title_column, rank
        self.keys = CommittedTable(spark, f"{path}/keys", "key", spark.createDataFrame([], "key string, batch string").schema)

    def _keys(self, rows: DataFrame) -> DataFrame:
        of = [F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) for i, c in enumerate(self.names[:2])]
        return rows.select(F.explode(F.array_compact(F.array(of[0], F.when(F.col(self.names[1]) != "", of[1])))).alias("key"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:012d}"
        if name in self.keys.manifest().batches:
            return
        rows = batch.select(*self.schema.names)
        seen = self.keys.lookup(self._keys(rows))
        for i, c in enumerate(self.names[:2]):
            key = F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))
            rows = rows.join(seen.select(F.col("key").alias("_seen")), key == F.col("_seen"), "left_anti") if i == 0 else rows.join(seen.select(F.col("key").alias("_seen")), (key == F.col("_seen")) & (F.col(c) != ""), "left_anti")
        dedup_documents(rows, *self.names).write.mode("overwrite").parquet(f"{self.path}/rows/{name}")
        kept = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{name}")
        self.keys.upsert(self._keys(kept).withColumn("batch", F.lit(name)), name)

    def rows(self) -> DataFrame:
        """All rows that were kept."""
        done = sorted(self.keys.manifest().batches)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{b}" for b in done]) if done else self.spark.createDataFrame([], self.schema)
