"""Graph and search operators over whole tables, against plain Python."""

from pyspark.sql import functions as F

from quarry.operators import graph, search

SF = "/root/testdata/sf0.001"


def test_edges_of_all_lineitem(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    edges = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("rel")).distinct()
    plain = {(f"s{r[0]}", f"p{r[1]}") for r in lines.select("l_suppkey", "l_partkey").collect()}
    assert [r["node"] for r in graph.neighbors(edges, "s1", ["SUPPLIES"]).collect()] == sorted(d for s, d in plain if s == "s1")[:100]
    ids = sorted({x for e in plain for x in e})[::2]
    nodes = spark.createDataFrame([(i, "org", i) for i in ids], "id string, type string, name string")
    kept = {(r["src"], r["dst"]) for r in graph.upsert_edges(edges, nodes).collect()}
    assert kept == {e for e in plain if e[0] in ids and e[1] in ids}
    more = {r["id"] for r in graph.with_satellites(nodes, edges).where("type = 'satellite'").collect()}
    assert more == {x for e in plain for x in e} - set(ids)
    merged = spark.createDataFrame([("s2", "s1")], "from_id string, to_id string")
    moved = {(r["src"], r["dst"]) for r in graph.redirect(edges, merged).collect()}
    assert moved == {("s1" if s == "s2" else s, d) for s, d in plain}


def test_latest_of_a_longer_history(spark):
    history = [(f"{'ab' if i % 2 else 'cd'}{i % 7} t{i}", i) for i in range(350)]
    titles = [(1, "ab3 t10"), (2, "cd6 t349"), (3, "xyz")]
    got = search.history_similarity(spark.createDataFrame(titles, "k long, title string"), spark.createDataFrame(history, "title string, at long"), "k", "title").collect()
    latest = [t for t, at in history if at >= 150]
    for r in got:
        own = set(dict(titles)[r["k"]])
        assert abs(r["novelty"] - (1 - max(len(own & set(o)) / len(own | set(o)) for o in latest))) < 1e-9


def test_paths_through_a_hub(spark):
    """Three hubs between two nodes, and a start of many edges: the first paths in order, and no more trails than asked for."""
    edges = [("s", f"a{i}") for i in range(40)] + [(f"a{i}", f"h{j}") for i in range(40) for j in range(3)] + [(f"h{j}", "g") for j in range(3)]
    df = spark.createDataFrame([(a, b, "R", i) for i, (a, b) in enumerate(edges)], "src string, dst string, rel string, eid long")
    every = sorted(["s", f"a{i}", f"h{j}", "g"] for i in range(40) for j in range(3))
    assert [r["path"] for r in graph.shortest_path(df, "s", "g", 4, 7).collect()] == every[:7]
    assert graph.shortest_path(df, "s", "nowhere").count() == 0
    got = graph.chain(df, "s", ["R"], 3, limit=50).collect()
    first = [[i] for i in range(40)] + sorted([i, k] for i in range(40) for k, (a, _) in enumerate(edges) if a == f"a{i}")
    assert [r["eids"] for r in got] == first[:50]


def test_chain_edges_of_many_suppliers(spark, tmp_path):
    """The query on 60,000 suppliers, a fifth of them two steps from the region: more trails than any number that a query names."""
    from quarry.plans import registry

    spark.range(60_000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).select(F.col("id").alias("n_nationkey"), (F.col("id") % 5).alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    got = sorted(r["eid"] for r in registry.QUERIES["chain_edges"](spark, str(tmp_path)).collect())
    assert got == sorted([f"b{n}" for n in range(25) if n % 5 == 1] + [f"a{i}" for i in range(60_000) if i % 5 == 1])


def test_tfidf_writes_little(spark):
    """Counted terms are written as compressed columns: two bytes a row here, where a checkpoint of rows takes nine."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    docs = spark.createDataFrame([(i, [f"term{(i * 31 + j * 17) % 3000}" for j in range(200)]) for i in range(200)], "id long, terms array<string>")
    before = size()
    assert search.tfidf(docs, "id", "terms").count() == 200 * 5
    assert 0 < size() - before < 200 * 200 * 4
