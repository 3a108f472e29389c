"""Sharding by size-tiered compaction, with DataFrame functions only.

A dataset is a folder of immutable shard files and numbered manifests. append() writes arrivals as small shards and commits
a manifest with them; compact() merges the files of a tier, once it has FAN_IN of them, into files of the target size,
which belong to higher tiers, until no tier is full. A file's tier follows from its size: each is FAN_IN times the one
before. A manifest is written under another name and renamed to the next version, which only one writer can
do; readers take the highest version and see either all of a change or nothing. Old files stay until vacuum(), or until
their merge is committed where compact() is told so.

What passes the driver is the list of files, one entry for each, never rows. A merge reads each row once and writes it once,
without a shuffle: every new file takes whole splits of the old ones, as many as fill it, so no key can make a file large.

Defined results: every arriving row is in exactly one shard, whatever nulls, ties, repeated rows, empty or very long
texts it has; columns named shard or version are carried inside the shards and replaced in what read() adds; an
empty arrival commits nothing; reading a dataset without a manifest is an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import hadoop_fs, new_path, table

FAN_IN = 4
TARGET_BYTES = 128 << 20
#: Size under which files are of tier 0.
SMALL_BYTES = 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]


def tier(size: int, small: int = SMALL_BYTES) -> int:
    t = 0
    while size >= small:
        size //= FAN_IN
        t += 1
    return t


class ShardedDataset:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, small: int = SMALL_BYTES) -> None:
        self.spark, self.path, self.target, self.small = spark, path.rstrip("/"), target, small

    # --- manifests ---

    def _list(self, folder: str, suffix: str) -> list[tuple[str, int]]:
        fs, p = hadoop_fs(self.spark, folder)
        if not fs.exists(p):
            return []
        found = ((s.getPath().toString(), s.getLen()) for s in fs.listStatus(p))
        return sorted((name, size) for name, size in found if name.endswith(suffix) and not name.rsplit("/", 1)[1].startswith(("_", ".")))

    def manifest(self) -> Manifest | None:
        names = [name for name, _ in self._list(f"{self.path}/manifests", ".json")]
        if not names:
            return None
        fs, p = hadoop_fs(self.spark, names[-1])
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        read = json.loads(text)
        return Manifest(read["version"], tuple(Shard(**s) for s in read["shards"]))

    def _commit(self, version: int, shards: list[Shard]) -> Manifest:
        """Rename a complete manifest to the name of its version; fails where another writer has taken that."""
        made = Manifest(version, tuple(sorted(shards, key=lambda s: s.path)))
        fs, temporary = hadoop_fs(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(asdict(made)).encode()))
        finally:
            out.close()
        _, final = hadoop_fs(self.spark, f"{self.path}/manifests/v{version:012d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {version} is taken: another writer has committed")
        return made

    # --- writing ---

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return [Shard(name, size) for name, size in self._list(folder, ".parquet")]

    def append(self, arrivals: DataFrame) -> Manifest | None:
        """Commit the rows of arrivals as small shards, one for each of its partitions that has rows."""
        now = self.manifest()
        shards = self._write(arrivals)
        # of partitions without rows Spark writes a file for the first only, and only there is one looked for
        if shards and self.spark.read.parquet(shards[0].path).isEmpty():
            shards = shards[1:]
        if not shards:
            return now
        return self._commit(now.version + 1 if now else 1, [*(now.shards if now else ()), *shards])

    def _full_tier(self, shards: tuple[Shard, ...]) -> tuple[list[Shard], int] | None:
        """The files of the lowest full tier that a merge makes fewer, and the number of files to make of them."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target * 3 // 4:
                tiers.setdefault(tier(s.size, self.small), []).append(s)
        for _, run in sorted(tiers.items()):
            files = max(1, round(sum(s.size for s in run) / self.target))
            if len(run) >= FAN_IN and files < len(run):
                return sorted(run, key=lambda s: s.path), files
        return None

    def compact(self, keep_old: bool = True) -> Manifest | None:
        """Merge full tiers, the lowest first, until none is full; each merge is a version of its own. Merged files are
        deleted once the version without them is committed, unless keep_old."""
        now = self.manifest()
        while now and (found := self._full_tier(now.shards)):
            run, files = found
            new = self._write(self.spark.read.parquet(*[s.path for s in run]).coalesce(files))
            gone = set(run)
            now = self._commit(now.version + 1, [*(s for s in now.shards if s not in gone), *new])
            if not keep_old:
                self._delete([s.path for s in run])
        return now

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            fs, p = hadoop_fs(self.spark, path)
            fs.delete(p, False)

    # --- reading ---

    def read(self) -> DataFrame:
        """All rows of the latest version, with shard (the file's path within the dataset) and version."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"{self.path} has no manifest")
        rows = self.spark.read.parquet(*[s.path for s in now.shards])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"data/([^/]+/[^/]+)$", 1)
        return rows.select(*[c for c in rows.columns if c not in ("shard", "version")], name.alias("shard"), F.lit(now.version).alias("version"))

    def vacuum(self) -> None:
        """Delete shards that the latest version does not hold."""
        now = self.manifest()
        live = {s.path for s in now.shards} if now else set()
        fs, p = hadoop_fs(self.spark, f"{self.path}/data")
        folders = [f.getPath().toString() for f in fs.listStatus(p)] if fs.exists(p) else []
        self._delete([name for folder in folders for name, _ in self._list(folder, ".parquet") if name not in live])


#: Arrivals into which the query deals the table.
ARRIVALS = 4


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    data = ShardedDataset(spark, new_path(spark, "sharded"))
    arrival = F.pmod(F.xxhash64("_metadata.row_index"), F.lit(ARRIVALS))
    for i in range(ARRIVALS):
        data.append(docs.where(arrival == i))
        data.compact(keep_old=False)
    return data.read().select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars", "shard", "version")
