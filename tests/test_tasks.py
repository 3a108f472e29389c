"""Merges, keys, feedback, staging, copies, corpora and micro-batches on small fixtures."""

from pyspark.sql import functions as F

from quarry.operators import entities, graph, models, signals
from quarry.sources import readers
from quarry.streaming import streams


def test_merged_entities_and_their_edges(spark):
    records = spark.createDataFrame([("a", "", 0.5, "x"), ("b", "B", 0.9, "y"), ("c", "C", None, None), ("d", "D", 0.1, None)], "id string, name string, confidence double, extra string")
    merged = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "nobody"), ("a", "a")], "from_id string, to_id string")
    got = {r["id"]: (r["name"], r["confidence"], r["extra"], r["filled"]) for r in entities.merge_entities(records, merged, "id", ["name", "confidence"]).collect()}
    assert got == {"a": ("B", 0.9, "x", ["name", "confidence"]), "d": ("D", 0.1, None, [])}
    edges = spark.createDataFrame([("b", "d", "R"), ("a", "d", "R"), ("a", "c", "R")], "src string, dst string, rel string")
    assert [tuple(r) for r in graph.redirect(edges, merged.where("to_id = 'a'")).select("src", "dst", "rel").collect()] == [("a", "d", "R")]


def test_keys_of_a_record(spark):
    rows = spark.createDataFrame([("n", "e", '{"mail": "m@x", "doi": ""}', "own"), ("n", None, None, ""), ("", "e", '{"doi": "10.1/a"}', "own")], "full_name string, employer string, features string, doi string")
    pair = rows.select(entities.entity_keys([], F.col("features"), ["full_name", "employer"]).alias("k")).collect()
    assert [r["k"] for r in pair] == [{"full_name_employer": "n|e", "email": "m@x"}, {}, {"doi": "10.1/a"}]
    single = rows.select(entities.entity_keys(["doi"], F.col("features")).alias("k")).collect()
    assert [r["k"] for r in single] == [{"doi": "own", "email": "m@x"}, {}, {"doi": "10.1/a"}]


def test_feedback_and_errors(spark):
    topics = spark.createDataFrame([(1, "pending"), (2, "revised"), (3, None)], "id long, status string")
    feedback = spark.createDataFrame([(1, "accept", 1), (1, "reject", 2), (2, "odd", 9), (9, "accept", 1)], "id long, rating string, at long")
    got = entities.apply_feedback(topics, feedback, "id", ["at"]).collect()
    assert {r["id"]: r["status"] for r in got} == {1: "rejected", 2: "revised", 3: None}
    gated = spark.createDataFrame([(1, "PASS"), (2, "REJECT"), (3, None)], "id long, outcome string")
    good, bad = entities.split_outcomes(gated, F.repeat(F.lit("x"), F.lit(2000)), "clean")
    assert [r["id"] for r in good.collect()] == [1] and sorted((r["id"], r["stage"], len(r["error_msg"])) for r in bad.collect()) == [(2, "clean", 1000), (3, "clean", 1000)]


def test_staged_triples(spark):
    df = spark.createDataFrame([(None, "p" * 100, None)], "subject string, predicate string, confidence double")
    assert [tuple(r) for r in models.staged(df).collect()] == [("", "p" * 64, 0.0, False)]


def test_burst_proxy(spark):
    df = spark.createDataFrame([("Solar cell",)] + [("other",)] * 19 + [(None,)], "tag string")
    assert df.agg(signals.burst_proxy(F.lit("SOLAR"), F.col("tag"))).first()[0] == 0.5
    assert df.limit(0).agg(signals.burst_proxy(F.lit("SOLAR"), F.col("tag"))).first()[0] == 0.0


def test_copies_in_windows(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 3).alias("k"), F.lit("v").alias("v"))
    bounds = readers.key_windows(df, "k", 700)
    sizes = [df.where((F.col("k") >= a) & (F.col("k") < b)).count() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert sum(sizes) == 5000 and max(sizes) <= 800 and min(sizes) > 0 and readers.key_windows(df.limit(0), "k", 10) == []
    path = f"{tmp_path}/copy"
    first = readers.copy_table(df, path, "k", 100, cap=1000)
    assert readers.copy_table(df, path, "k", 100, cap=1000) == first
    copied = spark.read.parquet(path)
    assert copied.count() == copied.select("k").distinct().count() == 1000 and copied.agg(F.max("k")).first()[0] == 2997
    readers.copy_table(df, path, "k", 1000, last=2997)
    whole = spark.read.parquet(path)
    assert whole.count() == whole.select("k").distinct().count() == 5000


def test_tables_over_jdbc(spark):
    url = "jdbc:derby:memory:quarry;create=true"
    spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name")).coalesce(1).write.jdbc(url, "things", "overwrite", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    got = readers.jdbc_table(spark, url, "things", "id", 0, 100, 4, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("id")).first()[0] == 4950


def test_a_failed_source_is_empty(spark, tmp_path):
    good = spark.createDataFrame([("s", "1", "text", None, None)], readers.CORPUS_SCHEMA)
    broken = good.withColumn("text", F.raise_error(F.lit("no connection")).cast("string"))  # fails when it is read
    missing = lambda: spark.read.schema(readers.CORPUS_SCHEMA).parquet(f"{tmp_path}/none")
    assert [r["doc_id"] for r in readers.union_corpora(spark, [lambda: broken, missing, lambda: good]).collect()] == ["1"]


def test_rss_and_dictionary(spark, tmp_path):
    feed = tmp_path / "feed.xml"
    items = "".join(f"<item><title>{t}</title><link>l</link><description>d</description></item>" for t in ("Solar one", "wind", "SOLAR two", "solar three"))
    feed.write_text(f"<rss><channel>{items}</channel></rss>")
    readers.register(spark)
    got = spark.read.format("quarry_rss").option("url", feed.as_uri()).option("max_items", "2").option("keywords", '["solar"]').load().collect()
    assert [r["title"] for r in got] == ["Solar one", "SOLAR two"] and got[0]["published"] is None
    names = tmp_path / "names.tsv"
    names.write_text("# note\na01b\tSowing\nbroken\nx\ty\tz\n")
    assert [tuple(r) for r in readers.dictionary(spark, str(names)).collect()] == [("A01B", "Sowing")]


def test_micro_batches_with_a_hook(spark, tmp_path):
    df = spark.range(10).withColumn("kind", F.lit("a"))
    for i in range(3):
        df.withColumn("id", F.col("id") + 10 * i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ran = []

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")
        ran.append(batch.count())

    for _ in range(2):  # the second run finds nothing new
        streams.run_batches(streams.file_stream(spark, f"{tmp_path}/in", df.schema, 1), each, f"{tmp_path}/checkpoint").awaitTermination()
    assert ran == [10, 10, 10] and spark.read.parquet(f"{tmp_path}/out").count() == 30
