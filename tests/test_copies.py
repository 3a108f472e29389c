"""Copies by bisection and open-ended paging."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from quarry.sources import readers


def test_copy_in_key_order_makes_few_files(spark, tmp_path):
    rows = spark.range(4000).repartition(16).withColumn("v", F.col("id") * 2)
    bounds = readers.copy_table(rows, f"{tmp_path}/t", "id", 100)
    assert len(bounds) == 41
    files = list((tmp_path / "t").glob("win=*/*.parquet"))
    assert 40 <= len(files) <= 40 + 4 and spark.read.parquet(f"{tmp_path}/t").count() == 4000
    assert readers.copy_table(rows, f"{tmp_path}/c", "id", 100, cap=250)[-1] == 250
    assert spark.read.parquet(f"{tmp_path}/c").count() == 250


def test_bisection(spark, tmp_path):
    """A source that fails on more than 100 rows, and always on one key, is copied all but that key; a second run goes on."""
    asked = []

    def read(low, high, most=100, bad=(777,)):
        asked.append((low, high))
        fails = F.raise_error(F.lit("too much")).cast("long")
        broken = high - low > most or any(low <= b < high for b in bad)
        return spark.range(low, high, 1, 8).select((fails if broken else F.col("id")).alias("id"))

    path = f"file://{tmp_path}/b"
    done = readers.copy_by_bisection(spark, read, [0, 300, 1000], path)
    assert done["failed"] == [(777, 778)] and not done["skipped"]
    schema = spark.range(1).schema
    assert sorted(r["id"] for r in readers.copied(spark, path, schema).collect()) == [i for i in range(1000) if i != 777]
    assert all(high - low <= 100 for low, high in done["copied"])
    assert all(len(list(p.glob("*.parquet"))) <= 4 for p in (tmp_path / "b").iterdir())
    asked.clear()
    again = readers.copy_by_bisection(spark, lambda low, high: read(low, high, bad=()), [0, 1100], path)
    assert sorted(again["copied"]) == [(777, 778), (1000, 1100)] and len(asked) == 2
    assert readers.copied(spark, path, schema).count() == 1100


class Pages(http.server.BaseHTTPRequestHandler):
    items: list = []
    asked: list = []

    def do_GET(self):
        query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
        Pages.asked.append(self.path)
        if self.path.startswith("/cursor"):
            at = int(query.get("after", ["0"])[0])
            body = {"data": {"rows": [{"id": i} for i in Pages.items[at : at + 5]], "next": str(at + 5) if at + 5 < len(Pages.items) else None}}
        else:
            at = (int(query["page"][0]) - 1) * 5
            body = {"data": {"rows": [{"id": i, "more": {"x": [i]}} for i in Pages.items[at : at + 5]]}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


@pytest.mark.parametrize("kind", ["page", "cursor"])
def test_open_ended_pages(spark, tmp_path, server, kind):
    readers.register(spark)
    options = {"url": f"{server}/{kind}", "items": "data.rows", "fields": json.dumps({"id": "id", "x": "more.x"}), "page_size": "5", "pages_per_batch": "2", "per_second": "200"}
    options |= {"page_param": "page"} if kind == "page" else {"page_param": "after", "cursor_path": "data.next"}

    def run():
        stream = spark.readStream.format("quarry_pages").options(**options).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
        return sorted(int(r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    Pages.items, Pages.asked = list(range(23)), []
    assert run() == list(range(23))
    # more items on the page that was short, and more pages: a new run loses and repeats nothing
    Pages.items = list(range(41))
    assert run() == list(range(41))
    assert run() == list(range(41))


def test_a_batch_is_read_again_by_its_offsets(server):
    Pages.items = list(range(23))
    reader = readers.PagesReader({"url": f"{server}/page", "items": "data.rows", "fields": json.dumps({"id": "id"}), "page_size": "5", "page_param": "page", "pages_per_batch": "2"})
    at, all_rows = reader.initialOffset(), []
    for _ in range(5):
        rows, after = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, after)) == rows
        all_rows += rows
        at = after
    assert [int(r[0]) for r in all_rows] == list(range(23)) and at == {"page": "5", "taken": "3"}
