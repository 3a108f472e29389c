"""Scalar functions and operators on small values."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import entities, graph, search, signals
from quarry.sources import readers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("f, value, expected", [
    (S.normalize_org_name, "Ａ公司", "A公司"), (S.normalize_org_name, None, ""), (S.normalize_org_name, "甲　公司", "甲公司"),
    (S.strip_org_suffix, "北京航空航天大学", "北京航空航天"), (S.strip_org_suffix, "华为技术有限公司", "华为技术"), (S.strip_org_suffix, "中国科学院", "中国科学院"),
    (S.clean_text, "  hello\x00world  ", "helloworld"), (S.clean_text, "a  b", "a b"), (lambda c: S.truncate_text(c, 5), "abcdefg", "abcde…"), (lambda c: S.truncate_text(c, 10), "abc", "abc"),
    (S.title_key, "量子！纠错，方法", "量子 纠错 方法"), (S.normalize_term, "mass spectrometry", "质谱仪"), (S.normalize_term, "CNN。", "cnn"),
    (S.ipc_subclass, "G06T7/00(2017.01)I", "G06T"), (S.ipc_subclass, "XYZ", None), (S.ipc_subclass, None, None), (S.degree, "工学博士", "博士"), (S.degree, "学士", "本科"),
    (S.name_id, "李四", "name:李四"), (S.name_id, " ", None), (S.fenced_json, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'), (S.fenced_json, 'say {"a": 2} now', '{"a": 2}'),
])
def test_text(spark, f, value, expected):
    assert one(spark, f, value) == expected


@pytest.mark.parametrize("value, expected", [("2023-06-15", "2023-06-15"), ("2023/06/15", "2023-06-15"), ("2023年6月15日", "2023-06-15"), ("2023.06.15", "2023-06-15"), ("20230615", "2023-06-15"), ("2023-06", "2023-06-01"), ("2023年6月", "2023-06-01"), ("2023", "2023-01-01"), ("202311", None), ("no", None)])
def test_dates(spark, value, expected):
    assert one(spark, S.normalize_date, value) == (datetime.date.fromisoformat(expected) if expected else None)


def test_lists(spark):
    assert one(spark, S.split_list, "a；; b ,c") == ["a；", "b", "c"]
    assert one(spark, S.name_list, '["A", "B"]') == ["A", "B"]
    assert one(spark, S.name_list, "A;B") == ["A", "B"]


@pytest.mark.parametrize("x, history, expected", [(5, [5, 5, 5], 0), (9, [3, 7], 2), (1, [5, 5, 5], 0), (10, [], 0)])
def test_burst(spark, x, history, expected):
    got = spark.createDataFrame([(float(x), history)], "x double, h array<int>").select(S.burst_zscore(F.col("x"), F.col("h"))).first()[0]
    assert got == pytest.approx(expected, abs=1e-5)


@pytest.mark.parametrize("series, tau", [([1, 2, 3, 4, 5], 1), ([5, 4, 3, 2, 1], -1), ([3, 3, 3, 3], 0), ([1], 0), ([], 0)])
def test_mann_kendall(spark, series, tau):
    assert one(spark, S.mann_kendall, series, "array<int>") == tau


def test_velocity(spark):
    df = spark.createDataFrame([([2, 4, 8], 1.0), ([3, 3, 3], 1.0), ([2, 4, 8], 0.0)], "s array<int>, tau double")
    assert [r[0] for r in df.select(S.velocity(F.col("s"), F.col("tau"))).collect()] == pytest.approx([0.375, 0, 0.1875])


def test_dedup_is_sequential(spark):
    rows = [(0, "id1", "t1"), (1, "id2", "t1"), (2, "id2", "t3"), (3, "id4", None), (4, "id5", "")]
    df = spark.createDataFrame(rows, "rank long, raw_key string, title_key string")
    assert sorted(r["rank"] for r in entities.dedup_documents(df).collect()) == [0, 2, 3, 4]


def test_gate(spark):
    outcome, score = entities.gate(["title", "number"], ["a", "b", "c", "d"])
    df = spark.createDataFrame([("t", "n", None, " ", None, None), (None, "n", "a", "b", "c", "d"), ("t", "n", "a", "b", "c", "d")], "title string, number string, a string, b string, c string, d string")
    assert [tuple(r) for r in df.select(outcome, score).collect()] == [("DEGRADE", 0.3333), ("REJECT", 0.8333), ("PASS", 1.0)]


def test_bursting_keywords(spark):
    rows = [(i, "q", 20 if i == 4 else 1) for i in range(5)] + [(i, "a", 5) for i in range(5)] + [(0, "rare", 1)]
    got = {r["keyword"]: r for r in signals.burst_scores(spark.createDataFrame(rows, "slot_idx int, keyword string, cnt long"), 5, recent=1).collect()}
    assert got["q"]["bursting"] and not got["a"]["bursting"] and "rare" not in got


def test_rule_relations(spark):
    rows = [(1, "中科院资助量子纠错码项目开展研究。", [("o", "ORG", 0, 3), ("p", "PROJECT", 4, 11)]), (2, "清华大学聘请张三为研究员。", [("o", "ORG", 0, 4), ("x", "PERSON", 5, 7)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<entity_id:string,entity_type:string,start:int,end:int>>")
    got = {(r["doc_id"], r["src"], r["rel"]) for r in graph.rule_relations(df).collect()}
    assert (1, "o", "ORG_FUND_PROJECT") in got and (2, "o", "ORG_EMPLOY") in got


def test_span_selection(spark):
    df = spark.createDataFrame([([(0, 5, 0.8), (3, 8, 0.9), (9, 12, 0.7)],)], "spans array<struct<start:int,end:int,confidence:double>>")
    assert [(s["start"], s["end"]) for s in df.select(search.select_spans(F.col("spans"))).first()[0]] == [(3, 8), (9, 12)]


def test_trail_uses_an_edge_once(spark):
    e = spark.createDataFrame([("a", "b", "R", "1"), ("b", "a", "R", "2")], "src string, dst string, rel string, eid string")
    assert [r["path"] for r in graph.chain(e, "a", ["R"], 4).collect()] == [["a", "b"], ["a", "b", "a"]]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "src string, dst string, rel string, eid string")
    assert graph.chain(e, "a", ["R"], 2).count() == 0 and graph.shortest_path(e, "a", "b").count() == 0
    assert signals.adaptive_threshold(spark.createDataFrame([], "strength double")).first()["threshold"] == 0.4


def test_rest_reader(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"data": {"items": [{"id": 1, "n": {"cn": "甲"}}, {"id": 2}]}}')
    readers.register(spark)
    df = spark.read.format("quarry_rest").options(url=f"file://{tmp_path}/x.json", items="data.items", fields='{"id": "id", "name": "n.cn"}').load()
    assert sorted(map(tuple, df.collect())) == [("1", "甲"), ("2", None)]


def test_upsert_log(spark):
    old, new = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "k int, p string, q string"), spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, p string, q string")
    after, log = entities.upsert_with_log(old, new, "k", ["p", "q"])
    assert sorted(map(tuple, after.collect())) == [(1, "a", None), (2, "c", "y"), (3, "d", "z")]
    assert sorted((r["k"], r["field"], r["new_value"]) for r in log.collect()) == [(2, "p", "c"), (3, "p", "d"), (3, "q", "z")]


def test_weak_signals_at_the_threshold(spark):
    """Three sources twice each: by the C library's logarithms, as SQL has them, a diversity just below 1 and a strength just below 0.40; by Spark's own, 0.40."""
    seen = [("three", w, s, 1) for w, s in zip((0, 3, 5, 9, 12, 13), "abcabc", strict=True)]
    stats = signals.term_stats(spark.createDataFrame(seen, "term string, win int, source string, docs long"), 12, 15)
    assert stats.first()["diversity"] == -3 * (1 / 3 * math.log(1 / 3)) / math.log(3) < 1
    assert signals.weak_signals(stats, 12, theta=9.0).count() == 0


def test_network_of_a_signal_at_the_threshold(spark):
    """Three sources twice each and no burst: just below the threshold, so that there is neither a signal nor an edge."""
    days = zip(("2024-01-05", "2024-04-05", "2024-06-05", "2024-10-05", "2025-01-05", "2025-01-06"), "abcabc", strict=True)
    docs = spark.createDataFrame([(s, datetime.date.fromisoformat(d), ["three"]) for d, s in days], "source string, timestamp date, terms array<string>")
    related = spark.createDataFrame([("three", ["t5"])], "term string, related_tech_ids array<string>")
    found, edges = signals.discover(docs, "2025-01-01", "2025-03-25", 12, 15, related)
    assert found.count() == 0 and edges.count() == 0
