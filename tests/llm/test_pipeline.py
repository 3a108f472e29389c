"""The corpus pipeline, stage by stage: rows and columns, and kept documents and texts against brute force."""

import random

from pyspark.sql import functions as F
from test_llm import WORD, components, lines_by_hand, lowered, shingles

import corpus_pipeline
from quarry.llm.common import materialize


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.limit(3).unionByName(spark.createDataFrame([(None, "12 34", None, None, None), (9_000_001, None, "en", None, 0)], docs.schema))
    docs = materialize(docs.unionByName(more), "test-docs")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, sf), "test-stage")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert 0 < out.count() <= docs.count()
            docs = out
    assert out.count() == docs.count() and out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_kept_documents_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    by_lines = [(i, t) for (i, was), t in zip(texts, lines_by_hand([t for _, t in texts]), strict=True) if t == was or t.split()]
    out = materialize(corpus_pipeline.dedup_lines(spark, docs, sf), "test-stage")
    assert rows_of(out) == by_lines
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0

    sets = [shingles(t) for _, t in by_lines]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(links, range(len(sets)))
    kept = [r for k, r in enumerate(by_lines) if root[k] == k]
    out = materialize(corpus_pipeline.dedup_documents(spark, out, sf), "test-stage")
    assert rows_of(out) == kept

    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORD.findall(lowered(r["text"]))
        windows |= {tuple(w[p : p + min(10, len(w))]) for p in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    leaks = lambda w: any(tuple(w[p : p + n]) in windows for n in lengths for p in range(len(w) - n + 1))
    clean = [(i, t) for i, t in kept if not leaks(WORD.findall(lowered(t)))]
    assert rows_of(corpus_pipeline.decontaminate(spark, out, sf)) == clean and len(clean) < len(kept)


def test_language_stage_keeps_what_has_a_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = spark.createDataFrame([(9_000_001, "123 456 !!", None, None, 10), (9_000_002, "", "en", None, 0), (9_000_003, None, "en", None, 0)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(junk), "").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert not kept & {9_000_001, 9_000_002, 9_000_003} and len(kept & lettered) >= 0.98 * len(lettered)


def test_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test-stage")
        assert docs.count() == 0


def test_near_dedup_from_80_percent(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(600)]
    texts = []
    for group in range(30):  # chains: each text is near the one before it, at 0.78 to 0.87
        words = [f"g{group}{w}" for w in base[: rng.randint(150, 400)]]
        texts.append(words)
        for step in range(3):
            words = list(words)
            changed = round(len(words) * rng.uniform(0.014, 0.026))
            for at in rng.sample(range(10, len(words) - 10), changed):
                words[at] = f"x{group}.{step}.{at}"
            texts.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    component = list(range(len(texts)))
    between = 0
    for b in range(len(texts)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            near = common * 100 >= (len(sets[a]) + len(sets[b]) - common) * 80
            between += near and common * 100 < (len(sets[a]) + len(sets[b]) - common) * 85
            if near:
                low, high = sorted((component[a], component[b]))
                component = [low if c == high else c for c in component]
    assert between >= 20
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()}
    assert kept == {(i, " ".join(texts[i])) for i in set(component)}


def test_queries_import():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names}
