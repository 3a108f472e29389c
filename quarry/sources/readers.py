"""Sources and sinks: keyset and corpus scans, attachments, REST and RSS data sources, idempotent rewrites."""

from __future__ import annotations

import email.utils
import json
import math
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from quarry.session import checkpointed, delete_folder

CORPUS_SCHEMA = "source string, doc_id string, text string, timestamp date, entities array<string>"


def keyset_scan(df: DataFrame, key: str, last: int, limit: int, watermark: str | None = None, updated: str = "update_time") -> DataFrame:
    """The next rows after a key in key order (S1-S3); a watermark that is no date and time is ignored."""
    kept = df.where(F.col(key) > last)
    if watermark:
        try:
            datetime.fromisoformat(watermark)
        except ValueError:
            pass
        else:
            kept = kept.where(F.col(updated) > F.lit(watermark).cast("timestamp"))
    return kept.orderBy(key).limit(limit)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, properties: dict[str, str]) -> DataFrame:
    """A table over JDBC in ranges of its key, read in parallel."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties)


def key_windows(df: DataFrame, key: str, rows: int, last: int | None = None) -> list[int]:
    """Bounds of key windows of about rows rows each: window i holds the keys from bounds[i] on and below bounds[i + 1].

    Windows without rows do not arise, as bounds are quantiles of the keys above last. The list has one number for each window."""
    kept = df if last is None else df.where(F.col(key) > last)
    n, low, high = kept.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return []
    steps = -(-n // rows)
    inner = kept.agg(F.percentile_approx(key, [i / steps for i in range(1, steps)], 100 * steps)).first()[0] if steps > 1 else []
    return [*sorted({low, *inner}), high + 1]


def copy_table(df: DataFrame, path: str, key: str, rows: int = 50_000, cap: int | None = None, last: int | None = None) -> list[int]:
    """Copy a table in key order, at most cap rows of it, into a folder with one partition (win, its first key) for each window, and
    give the windows' bounds (S7-S9). To take up a copy, give the last key that is in it.

    A window that is copied again replaces itself, so that a run that was lost may be repeated with the same bounds."""
    taken = df if last is None else df.where(F.col(key) > last)
    # a capped table is sorted and cut once, and its windows are of what was kept
    taken = taken if cap is None else checkpointed(taken.orderBy(key).limit(cap))
    bounds = key_windows(taken, key, rows)
    if bounds:
        starts, width = bounds[:-1], math.isqrt(len(bounds)) + 1
        # looked up in two steps, so that a row is not compared with all bounds
        groups = F.array(*[F.array(*map(F.lit, starts[i : i + width])) for i in range(0, len(starts), width)])
        group = F.element_at(F.filter(groups, lambda g: g[0] <= F.col(key)), -1)
        # in order of the key, a window lies in a task or two and is as many files
        ordered = taken.where(F.col(key).isNotNull()).withColumn("win", F.array_max(F.filter(group, lambda b: b <= F.col(key)))).repartitionByRange("win", key)
        rewrite_window(ordered, path, "win")
    return bounds


def copy_by_bisection(spark: SparkSession, read: Callable[[int, int], DataFrame], bounds: list[int], path: str, at_once: int = 4, files: int = 4) -> dict[str, list[tuple[int, int]]]:
    """Copy a source window by window, read(low, high) being its rows with keys from low on and below high.

    A window that fails is cut in two, down to single keys; those that still fail are reported. Each finished window is a folder low_high of at most
    files files under path, which Spark marks when it is whole: a run that is repeated passes over what is finished, whichever way windows were cut the first time,
    and replaces what is not. Windows are copied at_once at a time. Returns the windows copied, skipped and failed."""

    def finished() -> list[tuple[int, int]]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        windows = [tuple(map(int, n.split("_"))) for n in names if re.fullmatch(r"-?\d+_-?\d+", n)]
        return sorted(w for w in windows if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{w[0]}_{w[1]}/_SUCCESS")))

    def missing(low: int, high: int, done: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """What of a window no finished one has."""
        for a, b in done:
            if b > low and a < high:
                if a > low:
                    yield low, a
                low = max(low, b)
        if low < high:
            yield low, high

    out: dict[str, list[tuple[int, int]]] = {"copied": [], "skipped": finished(), "failed": []}

    def copy(low: int, high: int) -> None:
        try:
            read(low, high).coalesce(files).write.mode("overwrite").parquet(f"{path}/{low}_{high}")
        except Exception as error:
            if high - low <= 1:
                print(f"key {low} cannot be read: {str(error)[:200]}")
                out["failed"].append((low, high))
                return
            delete_folder(spark, f"{path}/{low}_{high}")
            middle = (low + high) // 2
            copy(low, middle)
            copy(middle, high)
        else:
            out["copied"].append((low, high))

    open_ = [w for low, high in zip(bounds[:-1], bounds[1:], strict=True) for w in missing(low, high, out["skipped"])]
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(lambda w: copy(*w), open_))
    return {k: sorted(v) for k, v in out.items()}


def copied(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all finished windows of copy_by_bisection."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def corpus_scan(df: DataFrame, source: str, key: str, texts: list[str], date: str, entities: Column, period: tuple[str, str], limit: int) -> DataFrame:
    """Documents of one source whose date lies in the period, both days included."""
    parts = [p for c in texts for p in (F.lit(" "), F.coalesce(F.col(c).cast("string"), F.lit("")))][1:]
    text = F.regexp_replace(F.concat(*parts), r"(?U)^\s+|\s+$", "")
    day = F.col(date).cast("date")
    kept = df.where(day.isNotNull() & (day >= F.lit(period[0]).cast("date")) & (day <= F.lit(period[1]).cast("date")))
    out = kept.select(F.lit(source).alias("source"), F.col(key), text.alias("text"), day.alias("timestamp"), entities.alias("entities")).where("text <> ''")
    return out.orderBy(key).limit(limit).select("source", F.col(key).cast("string").alias("doc_id"), "text", "timestamp", "entities")


def union_corpora(spark: SparkSession, loaders: list[Callable[[], DataFrame]]) -> DataFrame:
    """All sources that can be read; one that fails, while it is planned or while it is read, counts as empty.

    Each is written once to the shared folder, which is where reading fails; corpora are scans of a limited length."""
    out = spark.createDataFrame([], CORPUS_SCHEMA)
    for load in loaders:
        try:
            out = out.unionByName(checkpointed(load()))
        except Exception as error:  # a source that cannot be reached must not stop the others
            print(f"source skipped: {str(error)[:200]}")
    return out


def attachments(df: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """Cleaned contents of listed originals."""
    return df.where("clean_content is not null").join(ids.select("original_id").distinct(), "original_id", "left_semi").orderBy("original_id").limit(limit)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """code and name of a tab-separated file with exactly two fields a line; # starts a comment."""
    lines = spark.read.text(path).where("not startswith(value, '#')").select(F.split("value", "\t").alias("f")).where("size(f) = 2")
    return lines.select(F.upper(F.col("f")[0]).alias("code"), F.col("f")[1].alias("name"))


def rewrite_window(df: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def nested(value: object, path: str) -> object:
    """The part of a JSON value at a dotted path."""
    for name in filter(None, path.split(".")):
        value = value.get(name) if isinstance(value, dict) else None
    return value


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def told(after: str | None, default: float) -> float:
    """Seconds to wait by a Retry-After header, which gives seconds or a date."""
    if not after:
        return default
    try:
        return max(0.0, float(after))
    except ValueError:
        pass
    try:
        return max(0.0, email.utils.parsedate_to_datetime(after).timestamp() - time.time())
    except ValueError:
        return default


def fetch(url: str, headers: dict[str, str], tries: int = 4, wait: float = 1.0) -> bytes:
    """GET with retries: 429 waits as told, 401 and 403 are final, others back off exponentially."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code in (401, 403) or attempt == tries - 1:
                raise
            time.sleep(told(error.headers.get("Retry-After"), wait * 2**attempt) if error.code == 429 else wait * 2**attempt)
        except OSError:
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise OSError(url)


class RestSource(DataSource):
    """format("quarry_rest"): options url, pages, page_param, items (dotted path), fields (JSON of column to dotted path), token."""

    @classmethod
    def name(cls) -> str:
        return "quarry_rest"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["fields"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return RestReader(dict(self.options))


class RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(i + 1) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        o = self.options
        url = o["url"]
        if o.get("page_param"):
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode({o["page_param"]: partition.number})
        headers = {"Authorization": f"Bearer {o['token']}"} if o.get("token") else {}
        for item in nested(json.loads(fetch(url, headers)), o.get("items", "")) or []:
            found = [nested(item, path) for path in json.loads(o["fields"]).values()]
            yield tuple(None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found)


class PagesSource(DataSource):
    """format("quarry_pages"), a stream of the items of a paged interface whose number of pages nobody knows.

    Options: url, page_param, page_size, items (dotted path), fields (JSON of column to dotted path), token; cursor_path (dotted path of the next cursor, which page_param
    then takes in place of numbers), pages_per_batch (10) and per_second (requests, no limit without). The offset is the next page or cursor and how many items of it have been
    taken: a page shorter than page_size is the end for now and is read on from there. A batch is asked for again after a failure by its offsets."""

    @classmethod
    def name(cls) -> str:
        return "quarry_pages"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["fields"]))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagesReader(dict(self.options))


class PagesReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.size = int(options.get("page_size", 100))
        self.asked = 0.0

    def initialOffset(self) -> dict:
        return {"page": "" if self.options.get("cursor_path") else "1", "taken": "0"}

    def _page(self, page: str) -> tuple[list, str | None]:
        """(items of a page, the next page)."""
        o = self.options
        if o.get("per_second"):
            time.sleep(max(0.0, self.asked + 1 / float(o["per_second"]) - time.time()))
            self.asked = time.time()
        query = {o.get("page_param", "page"): page} if page else {}
        url = o["url"] + ("&" if "?" in o["url"] else "?") + urllib.parse.urlencode(query) if query else o["url"]
        body = json.loads(fetch(url, {"Authorization": f"Bearer {o['token']}"} if o.get("token") else {}))
        items = nested(body, o.get("items", "")) or []
        if o.get("cursor_path"):
            after = nested(body, o["cursor_path"])
            return items, None if after in (None, "") else str(after)
        return items, str(int(page) + 1) if len(items) >= self.size else None

    def _rows(self, start: dict, most: int, end: dict | None = None) -> tuple[list[tuple], dict]:
        page, taken = start["page"], int(start["taken"])
        fields = json.loads(self.options["fields"]).values()
        rows: list[tuple] = []
        for _ in range(most):
            if end and (page, taken) == (end["page"], int(end["taken"])):
                break
            items, after = self._page(page)
            upto = int(end["taken"]) if end and page == end["page"] else len(items)
            for item in items[taken:upto]:
                found = [nested(item, path) for path in fields]
                rows.append(tuple(None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found))
            if after is None or (end and page == end["page"]):
                taken = max(taken, upto)
                break
            page, taken = after, 0
        return rows, {"page": page, "taken": str(taken)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = self._rows(start, int(self.options.get("pages_per_batch", 10)))
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start, 1 << 30, end)[0])

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""


class RssSource(DataSource):
    """format("quarry_rss"): options url, max_items, keywords (JSON array; any of them in title or summary, whatever the case)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_rss"

    def schema(self) -> str:
        return "title string, link string, summary string, published string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RssReader(dict(self.options))


class RssReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        words = [k.lower() for k in json.loads(self.options.get("keywords", "[]"))]
        left = int(self.options.get("max_items", 50))
        for item in ET.fromstring(fetch(self.options["url"], {})).iter("item"):
            row = tuple(item.findtext(n) for n in ("title", "link", "description", "pubDate"))
            text = f"{row[0]} {row[2]}".lower()
            if left and (not words or any(w in text for w in words)):
                left -= 1
                yield row


def register(spark: SparkSession) -> None:
    for source in (RestSource, PagesSource, RssSource):
        spark.dataSource.register(source)
