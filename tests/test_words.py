"""Many patterns at once, segmentation and induced words, and the mended edges of older operators, against plain Python."""

import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import models, records, search, words


def test_find_words(spark):
    rng = random.Random(2)
    listed = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(200)] + ["", "a", "aa"]
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 80))) for _ in range(100)] + [None, "", "a" * 1000]
    got = words.find_words(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "t", listed).collect()
    for r in got:
        t = texts[r["k"]] or ""
        want = {w: sum(t.startswith(w, i) for i in range(len(t))) for w in set(listed) if w and w in t}
        assert {x["word"]: x["n"] for x in r["words"]} == want and [x["word"] for x in r["words"]] == sorted(want)
    none = spark.createDataFrame([(1, "a", "clash")], "k long, t string, words string")
    assert words.find_words(none, "t", []).first()["words"] == []
    assert words.find_words(none.limit(0), "t", ["a"]).count() == 0


def test_time_does_not_follow_the_number_of_words(spark):
    rng = random.Random(3)
    some = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(20_000)]
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefghij ", k=20_000))) for i in range(40)], "k long, t string").repartition(1).cache()
    docs.count()

    def took(n):
        began = time.time()
        words.find_words(docs, "t", some[:n]).agg(F.sum(F.size("words"))).collect()
        return time.time() - began

    took(200)
    assert took(20_000) < 4 * took(200) + 3


def splits(text):
    for n in range(len(text)):
        for cuts in itertools.combinations(range(1, len(text)), n):
            yield [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)), strict=True)]


def test_segment(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choices("研究生命起源ab", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(60)}
    texts = ["".join(rng.choices("研究生命起源abx", k=rng.randint(1, 9))) for _ in range(60)]
    total = sum(counts.values())
    logs = {w: math.log(n / total) for w, n in counts.items()}
    value = lambda split: sum(logs.get(w, words.UNKNOWN if len(w) == 1 else -math.inf) for w in split)
    got = words.segment(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string"), "t", counts).collect()
    for r in got:
        best = max(map(value, splits(texts[r["k"]])))
        assert "".join(r["words"]) == texts[r["k"]] and value(r["words"]) == pytest.approx(best)
    odd = words.segment(spark.createDataFrame([(1, None), (2, ""), (3, " 研究  生命 "), (4, "研" * 50_000)], "k long, t string"), "t", {"研究": 3, "生命": 2, "研": 1}).collect()
    assert [r["words"] for r in odd[:3]] == [[], [], ["研究", "生命"]] and len(odd[3]["words"]) == 50_000
    assert words.segment(odd_table := spark.createDataFrame([(1, "ab")], "k long, t string"), "t", {}).first()["words"] == ["a", "b"] and odd_table.count() == 1


def test_induced_words(spark):
    """Words strung together without spaces are found again."""
    rng = random.Random(7)
    vocabulary = ["研究", "生命", "起源", "科学家", "发现", "大学"]
    texts = ["".join(rng.choices([*vocabulary, "的", "了", "在"], k=30)) + "。" for _ in range(200)]
    found = {r["word"]: r for r in words.induced_words(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), cohesion=1.5, freedom=1.5).collect()}
    assert set(vocabulary) - set(found) == set() and all(w in vocabulary for w in found)
    joined = Counter(t.count("科学家") for t in texts)
    assert found["科学家"]["n"] == sum(k * n for k, n in joined.items())
    assert words.induced_words(spark.createDataFrame([(None,), ("",)], "t string"), F.col("t")).count() == 0


def test_terms_of_bm25_are_taken_as_they_are(spark):
    docs = spark.createDataFrame([(1, "I like C++ and Keit"), (2, "c c c"), (3, "keit. (x) keitx"), (4, None)], "k long, t string")
    ids = lambda *terms: {r["k"] for r in search.bm25(docs, "k", F.col("t"), list(terms)).collect()}
    assert ids("c++") == {1} and ids("c") == {1, 2} and ids("Keit") == {1, 3} and ids("(x)") == {3} and ids("", "zz") == set()


def test_mended_edges(spark):
    with pytest.raises(ValueError, match="ensemble"):
        records.ensemble([], "doc")
    df = spark.createDataFrame([(None, "b", 1), ("a", "c", 2)], "x string, y string, k long")
    renamed = records.rename_fields(df, {"x": "name", "y": "name"}, ["k"], [])
    assert renamed.columns.count("name") == 1 and sorted(r["name"] for r in renamed.collect()) == ["a", "b"]
    prices = spark.createDataFrame([("m", 1, 1), ("m", 3, 1)], "model string, price_in long, price_out long")
    calls = spark.createDataFrame([("m", 1_000_000, 0)], "model string, tokens_in long, tokens_out long")
    assert [float(r["cost"]) for r in search.llm_cost(calls, prices).collect()] == [3.0]
    mapping = spark.createDataFrame([("p", "A", "B", "R2"), ("p", "A", "B", "R1")], "predicate string, subj_type string, obj_type string, rel string")
    triples = spark.createDataFrame([("p", "A", "B")], "predicate string, subj_type string, obj_type string")
    assert [r["rel"] for r in models.map_predicates(triples, mapping)[0].collect()] == ["R1"]


def test_failed_calls_are_told_from_empty_answers(spark):
    def client(prompts):
        if "boom" in prompts:
            raise ConnectionError("down")
        return ['{"a": 1}' if p == "good" else "none" for p in prompts]

    ask = lambda p: models.answer(spark.createDataFrame([(p,)], "p string"), F.col("p"), client, "a long", error="why").first()
    assert ask("good")["answer"]["a"] == 1 and ask("good")["why"] is None
    assert ask("boom")["why"] == "ConnectionError: down" and ask("empty")["why"] == "no answer in the form asked for"
