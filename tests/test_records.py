"""Record operators, dedup chains and odd keys on small fixtures."""

from pyspark.sql import functions as F

from quarry.operators import entities, records, search
from quarry.sources import readers


def by_rule(rows):
    ids, titles, kept = set(), set(), []
    for raw, title, rank in sorted(rows, key=lambda r: r[2]):
        if (raw is not None and raw in ids) or (title and title in titles):
            continue
        kept.append(rank)
        ids |= {raw} - {None}
        titles |= {title} - {None, ""}
    return kept


def test_dedup_documents_of_a_long_chain(spark):
    # each row conflicts with the one before it, by id and title in turn
    chain = [(f"i{(k + 1) // 2}", f"t{k // 2}", k) for k in range(40)]
    odd = [(None, "a", 100), (None, "b", 101), (None, "a", 102), ("x", None, 103), ("x", "", 104), ("y", "", 105), (None, None, 106)]
    rows = chain + odd
    got = entities.dedup_documents(spark.createDataFrame(rows, "raw_key string, title_key string, rank long")).select("rank").collect()
    assert sorted(r["rank"] for r in got) == by_rule(rows)


def test_weak_clusters_keep_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), (None, 3, "x")], "k string, at long, name string")
    got = entities.weak_clusters(df, ["k"], "at", lambda a, b: F.col(f"{a}name") == F.col(f"{b}name")).collect()
    assert sorted((r["at"], r["head"]) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_title_overlap_keeps_repeated_rows(spark):
    titles = spark.createDataFrame([("new lamp",), ("new lamp",), (None,)], "title string")
    techs = spark.createDataFrame([("lamp", 0.8)], "name string, score double")
    assert sorted(r["hot"] for r in search.title_overlap(titles, techs, "title", "name", "score").collect()) == [0.4, 0.8, 0.8]


def test_retry_after():
    assert readers.told("3", 1.0) == 3.0 and readers.told(None, 1.5) == 1.5 and readers.told("soon", 2.0) == 2.0
    assert readers.told("Wed, 21 Oct 2015 07:28:00 GMT", 1.0) == 0.0


def test_coerced_lists_and_logs(spark):
    df = spark.createDataFrame([(["ａ b ", "", "c"], "甲", "", "A"), (None, "乙", None, None)], "authors array<string>, org string, cn string, en string")
    got = df.select(records.coerce("authors", F.col("authors"), is_list=True).alias("a")).collect()
    assert got[0]["a"] == ["a b", "c"] and got[1]["a"] is None or got[1]["a"] == []
    rows, log = records.backfill_names(df, "org", "cn", "en", F.lower("en"))
    assert [(r["org"], r["new_value"]) for r in log.collect()] == [("甲", "a")] and rows.where("cn = 'a'").count() == 1


def test_created_records_are_logged(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "key string, v long")
    accepted, log, counts = records.create_records(new, spark.createDataFrame([("b",)], "key string"), "key")
    assert [r["key"] for r in accepted.collect()] == ["a"] and [(r["key"], r["field"]) for r in log.collect()] == [("a", "*")]
    assert [tuple(r) for r in counts.collect()] == [(1, 3)]
