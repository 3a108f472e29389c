"""The inverted index and the vector index against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import text_index, vector_index

RNG = random.Random(4)
WORDS = ["c++", "c#", "Keit", "ÉTÉ", *("".join(RNG.choices("abcdefg", k=RNG.randint(1, 5))) for _ in range(80))]


def terms_of(text):
    return re.findall(r"[^\W_]+(?:\+\+|#)?", (text or "").lower())


def bm25_by_hand(docs, queries, k):
    terms = [terms_of(t) for _, t in docs]
    average = sum(map(len, terms)) / len(terms)
    out = []
    for q, text in queries:
        scores = {}
        for w in set(terms_of(text)):
            df = sum(w in t for t in terms)
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            for i, t in enumerate(terms):
                if tf := t.count(w):
                    scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
        best = sorted((-round(s, 6), docs[i][0]) for i, s in scores.items())[:k]
        out += [(q, key, -s, r + 1) for r, (s, key) in enumerate(best)]
    return sorted(out)


def text_docs(n=400):
    docs = [(i, " ".join(RNG.choices(WORDS, [1 / (j + 1) for j in range(84)], k=RNG.randint(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "c++ " * 500)] + [(n + 3 + i, docs[5][1]) for i in range(30)]
    return docs


def test_text_search(spark, monkeypatch):
    """Blocks of a few documents, so that most are passed over; ties of thirty equal documents; analysed terms."""
    docs, queries = text_docs(), [("a", "KEIT c++"), ("b", docs_text := "C# été keit"), ("c", "unknownword"), ("d", None), ("e", " ".join(WORDS))]
    assert docs_text
    for block, first in ((8, 1), (4096, 4)):
        monkeypatch.setattr(text_index, "BLOCK_DOCS", block)
        monkeypatch.setattr(text_index, "FIRST_BLOCKS", first)
        index = text_index.build(spark.createDataFrame(docs, "id long, body string"), "id", "body")
        got = text_index.search(index, spark.createDataFrame(queries, "q string, text string"), "q", "text", 10).collect()
        assert sorted((r["query"], r["key"], r["score"], r["rank"]) for r in got) == bm25_by_hand(docs, queries, 10)
    plan = index.table("postings").where("bucket in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_text_search_in_bounded_tasks(spark, monkeypatch, tmp_path):
    """More documents are more tasks of the build, not larger ones, and a block hands on the best documents of a query instead of all; slices of two queries."""
    monkeypatch.setattr(text_index, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}")
    for name, value in (("BLOCK_DOCS", 8), ("DEALT", 50), ("SLICE_BITS", 1), ("SLICE", 2), ("GATHERED", 100)):
        monkeypatch.setattr(text_index, name, value, raising=False)
    docs, queries = text_docs()[:400], [(i, " ".join(RNG.sample(WORDS, 30))) for i in range(7)]
    index = text_index.build(spark.createDataFrame(docs, "id long, body string"), "id", "body")
    files = index.table("postings").groupBy("bucket", F.input_file_name().alias("file")).agg(F.sum(F.size("hits")).alias("n"))
    assert files.agg(F.max("n")).first()[0] < files.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] / 2
    got = text_index.search(index, spark.createDataFrame(queries, "q long, text string"), "q", "text", 2).collect()
    assert sorted((r["query"], r["key"], r["score"], r["rank"]) for r in got) == bm25_by_hand(docs, queries, 2)
    assert spark.read.parquet(f"file://{tmp_path}/search/first").count() <= 7 * text_index.FIRST_BLOCKS * 4


def test_text_search_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, body string")
    index = text_index.build(empty, "id", "body")
    assert text_index.search(index, spark.createDataFrame([(1, "a")], "q long, text string"), "q", "text").count() == 0
    one = text_index.build(spark.createDataFrame([(1, "a b", "x"), (None, "b", "y")], "id long, body string, term string"), "id", "body")
    assert text_index.search(one, spark.createDataFrame([], "q long, text string"), "q", "text").count() == 0
    assert [r["key"] for r in text_index.search(one, spark.createDataFrame([(1, "a")], "q long, text string"), "q", "text").collect()] == [1]


def clustered(n=3000, dim=24, groups=40, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, dim))
    return centers[rng.integers(groups, size=n)] + 0.25 * rng.standard_normal((n, dim))


@pytest.fixture(scope="module")
def vectors(spark):
    v = clustered()
    v[2000:] = v[0]  # a third of all vectors are equal
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [1.0, 2.0]), (9004, []), (None, v[7].tolist())]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + odd
    return v, spark.createDataFrame(rows, "id long, vector array<double>")


def test_vector_search(spark, vectors):
    v, rows = vectors
    index = vector_index.build(rows, "id", "vector")
    x = np.vstack((v, v[7]))
    keys = [*range(len(v)), None]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = rows.where("id % 100 = 3 or id > 8999 or id is null")
    got = {}
    for r in vector_index.nearest(index, queries, "id", "vector", 15).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"], r["sim"]))
    assert set(got) == {i for i in range(len(v)) if i % 100 == 3} | {None}
    for q, hits in got.items():
        sims = np.round(x @ x[keys.index(q)], 9)
        want = sorted(zip(-sims, [-1 if k is None else k for k in keys], strict=True))[:15]
        assert [(-1 if k is None else k) for _, k, _ in sorted(hits)] == [k for _, k in want]
        assert np.allclose([s for *_, s in sorted(hits)], [-s for s, _ in want], atol=2e-9)
    # by default few lists are probed, their folders alone are read, and nearly all neighbours are found
    assert index.probes < len(index.centroids) / 2
    assert vector_index.recall(index, rows.where("id % 37 = 0 and id < 2000"), "id", "vector") >= 0.95
    plan = index.blocks([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    assert max(len(r["keys"]) for r in index.blocks().select("keys").collect()) <= 2 * vector_index.BLOCK + 64


def test_vector_search_hands_on_little(spark):
    """What tasks hand on hangs on their number, not on that of lists: with a row a query and list, memory and shuffles grow faster than the input."""
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered())], "id long, vector array<double>")
    index = vector_index.build(rows, "id", "vector", lists=100)
    for codes in (False, True):
        found = vector_index._probed(index, rows.where("id % 20 = 0"), "id", "vector", 100, 20, codes)
        assert 150 * 20 <= found.count() <= 150 * 20 * 2 * spark.sparkContext.defaultParallelism


def test_vector_search_by_weak_codes(spark, monkeypatch):
    """Candidates grow until codes find the neighbours, as with more rows; a task that sees the whole table hands on little, and the rows are the same."""
    monkeypatch.setattr(vector_index, "PARTS", 2)
    monkeypatch.setattr(vector_index, "CODE_WORDS", 8)
    x = np.random.default_rng(3).standard_normal((4000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = rows.where("id % 40 = 0")
    index = vector_index.build(rows, "id", "vector")
    assert vector_index.recall(index, queries, "id", "vector", num_candidates=200) < 0.9
    assert vector_index.recall(index, queries, "id", "vector") >= 0.9
    found = sorted(vector_index.search(index, queries, "id", "vector").collect())
    monkeypatch.setattr(vector_index, "KEPT", 5 * index.candidates)
    assert vector_index._probed(index, queries, "id", "vector", index.probes, index.candidates, True, 20).count() == 100 * 20
    assert sorted(vector_index.search(index, queries, "id", "vector").collect()) == found


def test_vector_search_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, vector array<float>")
    index = vector_index.build(empty, "id", "vector")
    assert vector_index.search(index, spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"), "id", "vector").count() == 0
    one = vector_index.build(spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<float>"), "id", "vector")
    assert [(r["query"], r["key"], r["sim"]) for r in vector_index.search(one, spark.createDataFrame([(1, [2.0, 0.0])], "id long, vector array<float>"), "id", "vector").collect()] == [(1, "a", 1.0)]
    assert vector_index.search(one, empty, "id", "vector").count() == 0
