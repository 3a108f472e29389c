"""Shared pieces of the training-data operators: tables, materialised steps and text hashing."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows and bytes in one Arrow batch, whichever is reached first. Texts may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Bytes of text handled at once inside a task; a single longer text is handled alone.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where unset in local mode, as in tests, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/quarry-checkpoints"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def finished_shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete a step's shuffle files when the step ends, not when the driver's garbage collector gets to them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage, survives lost executors and gives the planner true sizes.

    options go to the Parquet writer."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with finished_shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def hadoop_fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_quarry_path", None):
            with contextlib.suppress(Exception):
                fs, p = hadoop_fs(df.sparkSession, path)
                fs.delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark df for broadcasting only where its counted rows are within limit; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def free_name(name: str, taken: list[str]) -> str:
    """name, or with underscores before it a name that no column has."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def doc_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


# --- numpy kernels: whole batches of texts are split into words and hashed at once ---


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Masks of the lowest 0 to 8 bytes of a number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 512


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about CHUNK_BYTES of UTF-8; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ASCII white space, A-Z lower-cased) of adjacent segments.

    Returns their 64-bit hashes, the word offsets of the segments, and the words' first bytes. Eight bytes of each word are
    mixed into its hash at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    lowered = np.zeros(n + 8, dtype=np.uint8)
    np.bitwise_or(data, ((data - np.uint8(65)) < np.uint8(26)).view(np.uint8) << np.uint8(5), out=lowered[:n])
    space = np.ones(n + 1, dtype=bool)
    np.logical_or(data == 32, (data - np.uint8(9)) < np.uint8(5), out=space[:n])
    before = np.ones(n + 1, dtype=bool)
    before[1:] = space[:-1]
    edges = np.flatnonzero(before != space)
    starts, ends = edges[::2].copy(), edges[1::2].copy()
    # segments that meet within a run of bytes cut it in two
    cuts = np.unique(offsets)
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[~space[cuts] & ~before[cuts]]
    if len(cuts):
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    size = ends - starts
    eight = np.ndarray((n + 1,), dtype=np.uint64, buffer=lowered, strides=(1,))
    words = mix64((eight[starts] & _BYTES[np.minimum(size, 8)]) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(more):
        part = eight[starts[more] + at] & _BYTES[np.minimum(size[more] - at, 8)]
        words[more] = mix64(words[more] ^ (part * np.uint64(0xD6E8FEB86659FD93)))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(lowered[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return words, np.searchsorted(starts, offsets), starts


_STEP = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def hash_shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each segment the sorted distinct hashes of its k-word shingles; of its whole sequence where it has fewer words."""
    total = max(0, len(words) - k + 1)
    rolled = np.zeros(total, dtype=np.uint64)
    for i in range(k):
        rolled += words[i : i + total] * _STEP[i]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


# --- connected components ---


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node that each node of the edge table (src, dst) reaches.

    Each round gives every node the smallest label among itself and its neighbours, hooks the labels that an
    edge joins, and follows labels one step on, so the rounds grow with the logarithm of a component's length.
    Every round is written to the shared folder. Nodes without an edge are not returned.
    """
    both = edges.select("src", "dst").where("src <> dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = materialize(both, f"{name}-edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), f"{name}-labels")
    while True:
        ends = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("far")), "dst")
        seen = ends.groupBy(F.col("src").alias("node")).agg(F.min("far").alias("far"))
        step = labels.join(seen, "node").select("node", "component", F.least("component", "far").alias("best"))
        # a label that lies beside a smaller one is hooked to it
        hooks = step.where("best < component").groupBy(F.col("component").alias("label")).agg(F.min("best").alias("hook"))
        step = step.select("node", F.col("component").alias("old"), F.col("best").alias("label"))
        hooked = step.join(labels.select(F.col("node").alias("label"), F.col("component").alias("up")), "label", "left")
        hooked = hooked.select("node", "old", F.least("label", "up").alias("label")).join(hooks, "label", "left")
        new = materialize(hooked.select("node", F.least("label", "hook").alias("component"), "old"), f"{name}-labels")
        changed = new.where("component <> old").limit(1).count()
        discard(labels)
        labels = new.select("node", "component")
        labels._quarry_path = new._quarry_path
        if not changed:
            discard(both)
            return labels
