"""Merges to a fixed point, keyed upserts and committed tables."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import entities
from quarry.sources import committed
from quarry.sources.committed import CommittedTable, Conflict


def survivors_by_hand(pairs):
    step = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            step[a] = min(b, step.get(a, b))
    out = {}
    for a in step:
        path = [a]
        while path[-1] in step and path[-1] not in path[:-1]:
            path.append(step[path[-1]])
        out[a] = min(path[path.index(path[-1]) : -1]) if path[-1] in path[:-1] else path[-1]
    return {a: b for a, b in out.items() if a != b}


@pytest.mark.parametrize("seed", range(3))
def test_survivors(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(1000, 1100)] + [(5, 6), (6, 7), (7, 5), (8, 8), (9, None), (None, 9), (1, 10), (1, 11)]
    pairs += [(i, i + 1) for i in range(2000, 2070)] + [(2070, 2060)] + [(3000 + i, 3000) for i in range(200)] + [(4, 3), (3, 4), (2, 3)]
    pairs += [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(60)]
    got = {r["from_id"]: r["to_id"] for r in entities.survivors(spark.createDataFrame(pairs, "from_id long, to_id long")).collect()}
    assert got == survivors_by_hand(pairs)


def test_merges_keep_every_record_once(spark):
    rows = spark.createDataFrame([(i, None if i in (1, 50) else f"n{i}", float(i)) for i in range(1, 60)], "k long, name string, confidence double")
    merged = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 5), (6, 7), (6, 8), (9, 99), (99, 9), *((i, i - 1) for i in range(51, 60))], "from_id long, to_id long")
    got = {r["k"]: (r["name"], r["confidence"]) for r in entities.merge_entities(rows, merged, "k", ["name", "confidence"]).collect()}
    assert got[1] == ("n2", 2.0) and got[5] == ("n5", 5.0) and got[7] == ("n7", 7.0) and got[8] == ("n8", 8.0) and got[9] == ("n9", 9.0)
    assert got[50] == ("n51", 59.0)
    assert set(got) == set(range(1, 51)) - {2, 3, 4, 6}


def test_upsert_takes_the_last_of_a_key(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v long")
    new = spark.createDataFrame([("a", 3, 1), ("a", 2, 2), ("b", 5, 1), (None, 9, 1), (None, 8, 2)], "k string, v long, at long")
    after, log = entities.upsert_with_log(old, new, "k", ["v"], "at")
    assert sorted((r["k"], r["v"]) for r in after.collect()) == [("a", 2), ("b", 5)]
    assert sorted((r["k"], r["old_value"], r["new_value"]) for r in log.collect()) == [("a", "1", "2"), ("b", None, "5")]
    after, _ = entities.upsert_with_log(old, new, "k", ["v"])
    assert sorted((r["k"], r["v"]) for r in after.collect()) == [("a", 3), ("b", 5)]


def test_upsert_properties(spark):
    nodes = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {}), ("c", None)], "k string, p map<string,string>")
    updates = spark.createDataFrame([("a", {"x": "3"}, 2), ("a", {"x": "4", "z": "5"}, 1), ("a", {"y": None}, 3), ("d", {"q": "1"}, 1), ("d", {}, 2), (None, {"q": "2"}, 1), ("b", None, 1)], "k string, p map<string,string>, at long")
    got = {r["k"]: r["p"] for r in entities.upsert_properties(nodes, updates, "k", "p", ["at"]).collect()}
    assert got == {"a": {"x": "3", "z": "5"}, "b": {}, "c": {}, "d": {"q": "1"}}
    assert entities.upsert_properties(nodes, updates.limit(0), "k", "p", ["at"]).count() == 3


def table(spark, tmp_path, buckets=4):
    rows = spark.createDataFrame([], "k long, v string")
    return CommittedTable(spark, f"file://{tmp_path}/t", "k", rows.schema, buckets)


def state(t):
    return sorted((r["k"], r["v"]) for r in t.rows().collect())


def test_committed_table(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    assert t.rows().count() == t.log().count() == 0 and t.last is None
    assert t.upsert(batch(*((i, "a") for i in range(20)), (None, "x")), "one", last=19) == 1
    before = t.manifest()

    class Killed(RuntimeError):
        pass

    def killed(self, new):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(CommittedTable, "_commit", killed)
        with pytest.raises(Killed):
            t.upsert(batch((3, "b"), (100, "c")), "two", last=100)
    # what was written before the run was lost is not seen; repeated, the batch is there once
    assert t.manifest() == before and t.last == 19 and (100, "c") not in state(t)
    assert t.upsert(batch((3, "b"), (100, "c")), "two", last=100) == 2
    assert t.upsert(batch((3, "b"), (100, "c")), "two", last=100) == 2
    assert state(t) == sorted([(i, "b" if i == 3 else "a") for i in range(20)] + [(100, "c")])
    assert t.last == 100 and sorted((r["version"], r["k"]) for r in t.log().where("version = 2").collect()) == [(2, 3), (2, 100)]
    assert [r["v"] for r in t.errors().collect()] == ["x"]
    # buckets without a key of the batch keep their files
    same = [b for b, p in t.manifest().buckets.items() if before.buckets.get(b) == p]
    assert 0 < len(same) < 4
    assert t.vacuum() >= 3
    assert len(state(t)) == 21 and t.log().count() == 22


def test_two_writers(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    t.upsert(rows, "one")
    stale = t.manifest()
    t.upsert(rows.withColumn("v", rows.k.cast("string")), "two")
    with monkeypatch.context() as m:
        m.setattr(CommittedTable, "manifest", lambda self: stale)
        with pytest.raises(Conflict):
            t.upsert(rows, "three")
    assert state(t) == [(1, "1")] and committed.Manifest().version == 0


@pytest.mark.parametrize("cuts", [[], [7], [3, 40, 41], list(range(0, 90, 9))])
def test_two_key_dedup_over_batches(spark, tmp_path, cuts):
    """Any split into batches keeps what dedup_documents keeps of all rows, and a run that is lost and repeated keeps it once."""
    from quarry.streaming.streams import KeyedDedup

    rng = random.Random(6)
    rows = [(rng.choice([None, *map(str, range(25))]), rng.choice([None, "", *[f"t{i}" for i in range(25)]]), i) for i in range(90)]
    kept, ids, titles = [], set(), set()
    for i, t, r in rows:
        if i in ids or t in titles:
            continue
        kept.append(r)
        ids |= {i} - {None}
        titles |= {t} - {None, ""}
    schema = "i string, t string, r long"
    df = spark.createDataFrame(rows, schema)
    assert sorted(x["r"] for x in entities.dedup_documents(df, "i", "t", "r").collect()) == kept
    dedup = KeyedDedup(spark, f"file://{tmp_path}/d", df.schema, "i", "t", "r")
    commit = CommittedTable._commit
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 90], strict=True)):
        part = spark.createDataFrame(rows[a:b], schema)
        if n == 1:

            def killed(self, new):
                raise RuntimeError("killed")

            CommittedTable._commit = killed
            try:
                with pytest.raises(RuntimeError):
                    dedup(part, n)
            finally:
                CommittedTable._commit = commit
        dedup(part, n)
        dedup(part, n)
    assert sorted(x["r"] for x in dedup.rows().collect()) == kept


def test_ingest_goes_on_where_it_was_lost(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    source = spark.range(1, 101).select(F.col("id").alias("at"), (F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("v"))
    calls = []

    def transform(df):
        calls.append(df.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return df

    with pytest.raises(RuntimeError):
        committed.ingest(t, source, "at", 20, transform, order="at")
    assert 35 <= t.last <= 45 and len(calls) == 3 and max(calls) <= 22
    assert committed.ingest(t, source, "at", 20, order="at") >= 3 and t.last == 100
    assert state(t) == sorted((k, str(max(i for i in range(1, 101) if i % 7 == k))) for k in range(7))
    assert committed.ingest(t, source, "at", 20, order="at") == 0
