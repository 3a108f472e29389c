"""A table whose commits hold data, change log and last key together.

Rows lie in BUCKETS folders by the hash of their key. A commit writes new files for the buckets that the batch touches, the change log and the rows that are errors,
and then a manifest, which names the current folder of every bucket, with the batch's id and last key. The manifest is written whole under a name of its own and
renamed to the next version's, which fails if another writer has been there first. What a run wrote before it was lost is in no manifest and is never read;
repeating the batch commits it once, and repeating a committed batch does nothing.

A rename is exclusive on HDFS and local file systems; on a store without such renames writers need a lock. The manifest has one entry for each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.entities import last_of_key, upsert_with_log
from quarry.sources.readers import key_windows

BUCKETS = 32


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass
class Manifest:
    version: int = 0
    batch: str | None = None
    last: object = None
    buckets: dict[str, str] = field(default_factory=dict)
    batches: dict[str, object] = field(default_factory=dict)
    logs: list[str] = field(default_factory=list)


class CommittedTable:
    """A table under path with a key and columns (schema without partitions), and rows of key, field, old_value and new_value as its log."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.schema, self.n = spark, path.rstrip("/"), key, schema, buckets
        self.columns = [c for c in schema.names if c != key]

    # --- files ---

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._at("_commits")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))

    def manifest(self) -> Manifest:
        """The newest commit."""
        versions = self._versions()
        if not versions:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/_commits/{versions[-1]:012d}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest) -> None:
        fs, draft = self._at(f"_commits/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(new.__dict__).encode())
        out.close()
        _, final = self._at(f"_commits/{new.version:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {new.version} of {self.path} exists")

    # --- reading ---

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        paths = sorted({p for b, p in manifest.buckets.items() if buckets is None or int(b) in buckets})
        paths = [f"{self.path}/{p}" for p in paths]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._rows(self.manifest())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in keys, of which just the buckets are read."""
        wanted = keys.select(self.key).distinct()
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most one number a bucket
        return self._rows(self.manifest(), buckets).join(wanted, self.key, "left_semi")

    def log(self) -> DataFrame:
        """All changes: version, key, is_new, field, old_value, new_value."""
        kind = self.schema[self.key].dataType.simpleString()
        schema = f"version long, `{self.key}` {kind}, is_new boolean, field string, old_value string, new_value string"
        paths = [f"{self.path}/{p}" for p in self.manifest().logs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def errors(self) -> DataFrame:
        """Rows without a key, of all committed batches."""
        paths = [f"{self.path}/{p}".replace("/log/", "/errors/") for p in self.manifest().logs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    @property
    def last(self) -> object:
        """The last key, or whatever the newest commit was given as the place to go on from."""
        return self.manifest().last

    # --- writing ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def upsert(self, batch: DataFrame, batch_id: str, last: object = None, order: str | None = None) -> int:
        """Put a batch into the table and commit it; the version is returned, that of the earlier commit if this batch has been there."""
        base = self.manifest()
        if batch_id in base.batches:
            return base.batches[batch_id]
        name = uuid.uuid4().hex
        fresh, keyless = last_of_key(batch.select(*dict.fromkeys([*self.schema.names, *([order] if order else [])])), self.key, order)
        staged = f"{self.path}/staged/{name}"
        fresh.select(*self.schema.names).write.parquet(staged)
        fresh = self.spark.read.schema(self.schema).parquet(staged)
        touched = sorted(r[0] for r in fresh.select(self._bucket()).distinct().collect())  # at most one number a bucket
        after, log = upsert_with_log(self._rows(base, touched), fresh, self.key, self.columns)
        # a bucket is dealt by its keys, so that one with many rows is many tasks and files
        bucketed = after.withColumn("_bucket", self._bucket()).repartitionByRange("_bucket", self.key)
        bucketed.write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        log.select(F.lit(base.version + 1).cast("long").alias("version"), "*").write.parquet(f"{self.path}/log/{name}")
        keyless.select(*self.schema.names).write.parquet(f"{self.path}/errors/{name}")
        buckets = base.buckets | {str(b): f"data/{name}/_bucket={b}" for b in touched}
        new = Manifest(base.version + 1, batch_id, last, buckets, base.batches | {batch_id: base.version + 1}, [*base.logs, f"log/{name}"])
        self._commit(new)
        fs, path = self._at(f"staged/{name}")
        fs.delete(path, True)
        return new.version

    def vacuum(self) -> int:
        """Delete data folders that the newest commit doesn't name, and say how many; for when no other run reads or writes the table."""
        used = {p.split("/")[1] for p in [*self.manifest().buckets.values(), *self.manifest().logs]}
        gone = 0
        for part in ("data", "log", "errors", "staged"):
            fs, path = self._at(part)
            for status in fs.listStatus(path) if fs.exists(path) else []:
                if status.getPath().getName() not in used:
                    gone += fs.delete(status.getPath(), True)
        return gone


def ingest(table: CommittedTable, source: DataFrame, key: str, rows: int, transform: Callable[[DataFrame], DataFrame] = lambda df: df, order: str | None = None) -> int:
    """Take a source into the table in windows of about rows rows by its key, from the table's last key on (E2); the number of windows is returned.

    Each window is mapped, scored or related by transform, upserted, and committed with its last key: a run that is lost goes on with the window it was at,
    and a run on a source without newer keys does nothing. Keys are whole numbers that rise; a later row with an older key is not seen."""
    bounds = key_windows(source, key, rows, table.last)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        table.upsert(transform(source.where((F.col(key) >= low) & (F.col(key) < high))), f"{key} {low} to {high}", last=high - 1, order=order)
    return max(0, len(bounds) - 1)
