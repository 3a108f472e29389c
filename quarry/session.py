"""A session with the settings that the queries expect, and the folder that its driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # checkpoints go once nothing refers to them
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where unset in local mode, as in tests, a temporary folder; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/quarry-checkpoints"
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Limit the rows and bytes that a Python task is handed at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whichever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcasting if it has no more than most rows, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as compressed columns and read back: a checkpoint of long tables, which as rows take several times the room."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
