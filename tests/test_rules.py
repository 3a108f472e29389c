"""Rules by document type, searches over several fields, enrichment and ranking of words on small fixtures."""

import datetime
import json
import math

from pyspark.sql import functions as F

from quarry.operators import models, rules, search


def only(df):
    (row,) = df.collect()
    return row.asDict()


def test_patent(spark):
    rows = [(1, "WO2020/123456 of", "cn123456789a", "", "A61B 5/00; g06f17/30", "2020年3月5日", "x"), (2, None, " 77 ", "CN1234567890", None, None, None), (3, None, None, None, "", "", "")]
    df = spark.createDataFrame(rows, "k long, raw_AN string, application_number string, title string, raw_IPC string, application_date string, publication_date string")
    a, b, c = (r.asDict() for r in rules.extract(df, "patent", ["k"]).orderBy("k").collect())
    assert (a["cn_patent_number"], a["wo_patent_number"]) == (None, "WO2020/123456")  # the first field with a number decides
    assert a["ipc_codes"] == ["A61B 5/00", "g06f17/30"] and a["application_date"] == datetime.date(2020, 3, 5) and a["publication_date"] is None
    assert (b["application_number"], b["cn_patent_number"], b["wo_patent_number"]) == ("77", "CN1234567890", None)
    assert set(c.values()) == {3, None}


def test_other_types(spark):
    paper = spark.createDataFrame([(1, "doi:10.1234/ab.c x", "Li, Wu；Bo;  ", [" a ", "", None, "b"])], "k long, raw_doi string, authors string, keywords array<string>")
    assert only(rules.extract(paper, "paper", ["k"])) == {"k": 1, "doi": "10.1234/ab.c", "authors": ["Li", "Wu；Bo"], "keywords": ["a", "b"], "publish_date": None}
    project = spark.createDataFrame([(1, "", "Nr 12345678 of", "2019", None)], "k long, project_number string, title string, start_year string, end_year string")
    assert only(rules.extract(project, "project", ["k"])) == {"k": 1, "project_number": "12345678", "start_date": datetime.date(2019, 1, 1), "end_date": None}
    firm = spark.createDataFrame([(1, "about 1,200.5 (10k)", "2001-2-3")], "k long, reg_capital string, establish_date string")
    assert only(rules.extract(firm, "enterprise", ["k"])) == {"k": 1, "establish_date": datetime.date(2001, 2, 3), "reg_capital_amount": 1200.5}
    tender = spark.createDataFrame([(1, 5.5)], "k long, budget_amount double")
    assert only(rules.extract(tender, "tender", [])) == {"publish_date": None, "budget_amount": 5.5}
    assert rules.extract(tender, "other", ["k"]).columns == ["k"]


def test_best_field(spark):
    docs = spark.createDataFrame([(1, "red lamp", "a blue lamp of many words"), (2, "car", "red red"), (3, None, None), (4, "tree", "grass")], "k long, title string, body string")
    got = {r["k"]: r["score"] for r in search.best_field(docs, "k", {"title": 2.0, "body": 1.0}, ["red"]).collect()}

    def score(tf, n, mean, df, boost):
        return boost * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))

    assert got == {1: round(score(1, 2, 4 / 4, 1, 2), 6), 2: round(score(2, 2, 9 / 4, 1, 1), 6)}


def test_enrich(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "b", "x", "y"), (3, "c", None, "z"), (4, "d", "", None), (5, "e", None, None)], "k long, name string, area string, note string")
    said = {"a": (0.9, {"area": "A", "note": "N"}), "c": (0.65, {"area": "C", "note": "no"}), "d": (0.5, {"area": "D"})}

    def client(prompts):
        return [json.dumps({"confidence": said[p][0], "fields": said[p][1]}) if p in said else "none" for p in prompts]

    got = {r["k"]: (r["area"], r["note"], r["accepted"], r["needs_review"], r["before"], r["after"]) for r in models.enrich(df, ["name", "area"], ["note"], F.col("name"), client, least=0.7).collect()}
    assert got[1] == ("A", "N", True, False, 0.4, 1.0)
    assert got[2] == ("x", "y", False, False, 1.0, 1.0)
    assert got[3] == ("C", "z", True, True, 0.6, 1.0)  # a value present is not overwritten
    assert got[4] == ("", None, False, False, 0.4, 0.4)
    assert got[5] == (None, None, False, False, 0.4, 0.4)


def test_textrank(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, []), (3, None), (4, ["x"]), (5, ["p", "q"])], "k long, terms array<string>")
    got = [(r["k"], r["term"], r["rank"]) for r in search.textrank(docs, "k", "terms", k=2, span=2).orderBy("k", "rank").collect()]
    assert got == [(1, "b", 1), (1, "a", 2), (5, "p", 1), (5, "q", 2)]
