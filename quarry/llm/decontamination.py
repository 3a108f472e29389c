"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are lower-cased (A-Z) and split into words of digits, letters a-z and characters beyond ASCII. Every k-gram of
words is hashed, and of each window of consecutive k-grams the smallest hash is kept as a fingerprint, in documents
and benchmark items alike. Two texts that share WINDOW_WORDS = k + (k-grams in a window) - 1 words in a row therefore
always share a fingerprint. Documents that share one with an item are looked at again: each fingerprint hit is
extended to all the ten-word windows that contain it, and these are compared with the items' windows word for word.
Items of fewer than ten words are one window of their own length; where there are such items, documents are
compared with them by hashes of that length and then word for word too.

A document word inside any occurrence of a window is hit. Every row is split into words and fingerprinted in one pass,
which also counts its words; the second look is taken once for each different text (by md5), so null or repeated
doc_ids do no harm.

Defined results: a null, empty or wordless document has no words and no hits; null, empty or wordless items and
items without an item_id never match; repeated items count once; items_sha256 of a clean document is the sha256 of
the empty string; empty tables give an empty result (documents) or a clean one (benchmark); other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, discard, lower_ascii, materialize, table

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS, GRAM_WORDS = 10, 5
#: Fingerprints of the benchmark, windows of it, or keys and fingerprints of matched texts up to which a table is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _grams(column: str, k: int) -> Column:
    """Hashes of the k-grams of an array of word hashes that is a column of its own; the last k - 1 are of fewer words."""
    return F.transform(column, lambda x, i: F.xxhash64(x, *[F.get(column, i + j) for j in range(1, k)]))


def _lows(column: str, width: int) -> Column:
    """The smallest of each value and the width - 1 values after it."""
    return F.transform(column, lambda x, i: F.least(x, *[F.get(column, i + j) for j in range(1, width)])) if width > 1 else F.col(column)


def with_fingerprints(texts: DataFrame, window_words: int = WINDOW_WORDS, k: int = GRAM_WORDS) -> DataFrame:
    """texts (words) with hashes, grams and marks: the distinct smallest k-gram hash of every window of k-grams.

    Each step is a column of its own, so no step is computed more than once; explode_outer keeps Spark from adding a
    filter on the exploded array, which it would push below the steps, with all of them inside it."""
    hashed = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("grams", _grams("hashes", k)).withColumn("lows", _lows("grams", window_words - k + 1)).withColumn("marks", F.array_distinct("lows")).drop("lows")


def _windows(n: int) -> Column:
    at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " "))


def _mark(hash_: Column, n: int) -> Column:
    """The fingerprint of a gram of an item of n words."""
    return F.xxhash64(hash_, F.lit(n))


def _looked_at(docs: DataFrame, items: DataFrame, window_words: int, k: int) -> tuple[DataFrame, DataFrame]:
    """windows (n, window, items: sorted ids as strings) of the items, and of docs (text_key, text and others) for each row the others with
    text_key, n_words and null mark and n, and once more with each fingerprint (mark, of windows of n words) that it shares with an item."""
    # long items have one row for each window, short ones a single row
    lists = items.where("item_id is not null and text is not null").select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    long_items = lists.where(F.size("words") >= window_words)
    windows = long_items.select("item_id", F.explode_outer(_windows(window_words)).alias("window")).withColumn("n", F.lit(window_words))
    short = lists.where(F.size("words") < window_words).select("item_id", F.array_join("words", " ").alias("window"), F.size("words").alias("n"))
    windows = windows.unionByName(short).groupBy("n", "window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    windows = materialize(windows, "leak-windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # as many numbers as a window has words, at most

    marks = with_fingerprints(long_items, window_words, k).select(F.explode_outer("marks").alias("mark")).select(_mark(F.col("mark"), window_words).alias("mark"), F.lit(window_words).alias("n"))
    own = docs.withColumn("words", words(F.col("text"))).drop("text").withColumn("n_words", F.size("words").cast("long"))
    own = with_fingerprints(own, window_words, k).drop("grams").withColumn("found", F.transform("marks", lambda m: _mark(m, window_words))).drop("marks")
    for n in (n for n in lengths if n < window_words):
        keys = windows.where(F.col("n") == n).select(F.split("window", " ").alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        keys = keys.withColumn("grams", _grams("hashes", n)).select(_mark(F.element_at("grams", 1), n).alias("mark"), F.lit(n).alias("n"))
        marks = marks.unionByName(keys)
        own = own.withColumn("grams", _grams("hashes", n)).withColumn("short", F.array_distinct("grams")).withColumn("found", F.concat("found", F.transform("short", lambda m: _mark(m, n)))).drop("grams", "short")
    marks = materialize(marks.distinct(), "leak-marks")
    marks = broadcast_if_small(marks.withColumn("is_mark", F.lit(True)), marks.count(), BROADCAST_ROWS)
    # the null at the end of each row's fingerprints keeps one row of it
    own = own.drop("words", "hashes").withColumn("mark", F.explode_outer(F.concat("found", F.array(F.lit(None).cast("long"))))).drop("found")
    return windows, materialize(own.join(marks, "mark", "left").where("mark is null or is_mark").drop("is_mark"), "leak-looked")


def spans_and_rows(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, k: int = GRAM_WORDS) -> tuple[DataFrame, DataFrame]:
    """(text_key, start, n, items): word positions from 0 of all windows of items in the different texts of docs (text and
    others), and the sorted ids of the items that have the window; and the others, text_key and n_words of each row of docs."""
    texts = docs.withColumn("text_key", F.md5(F.col("text").cast("binary")))
    windows, looked = _looked_at(texts, items, window_words, k)
    n_windows = windows.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())
    rows = looked.where("mark is null").drop("mark", "n")
    if not lengths:
        none = F.array().cast("array<string>").alias("items")
        return texts.select("text_key", F.lit(0).alias("start"), F.lit(0).alias("n"), none).where("false"), rows
    hit_texts = materialize(looked.where("mark is not null and text_key is not null").groupBy("text_key").agg(F.collect_set(F.struct("n", "mark")).alias("all_marks")), "leak-texts")
    n_hit = hit_texts.agg(F.sum(F.size("all_marks") + 1)).first()[0] or 0

    # the texts that share a fingerprint, once each; every hit is extended to the windows that contain it
    again = texts.join(broadcast_if_small(hit_texts, n_hit, BROADCAST_ROWS), "text_key")
    again = again.groupBy("text_key").agg(F.first("text").alias("text"), F.first("all_marks").alias("all_marks"))
    again = again.select("text_key", "all_marks", words(F.col("text")).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    parts = []
    for n in lengths:
        width = k if n == window_words else n
        own = again.withColumn("own", F.transform(F.filter("all_marks", lambda m: m["n"] == n), lambda m: m["mark"])).where(F.size("own") > 0)
        own = own.withColumn("grams", _grams("hashes", width)).withColumn("grams", F.transform("grams", lambda h: _mark(h, n)))
        own = own.withColumn("at", F.array_compact(F.transform("grams", lambda h, i: F.when(F.array_contains("own", h), i))))
        own = own.withColumn("starts", F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(F.greatest(i - (n - width), F.lit(0)), i)))))
        own = own.withColumn("fit", F.filter("starts", lambda i: i + n <= F.size("words")))
        own = own.withColumn("spans", F.transform("fit", lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("window"))))
        parts.append(own.select("text_key", F.explode_outer("spans").alias("s")).select("text_key", "s.*"))
    spans = reduce(DataFrame.unionByName, parts)
    out = materialize(spans.join(broadcast_if_small(windows, n_windows, BROADCAST_ROWS), ["n", "window"]).select("text_key", "start", "n", "items"), "leak-spans")
    discard(hit_texts, windows)
    return out, rows


def contamination_spans(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, k: int = GRAM_WORDS) -> DataFrame:
    """The first result of spans_and_rows()."""
    return spans_and_rows(docs, items, window_words, k)[0]


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, k: int = GRAM_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids as strings) of each row of docs (doc_id, text)."""
    spans, counted = spans_and_rows(docs.select("doc_id", "text"), items, window_words, k)
    ends = spans.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # words covered by sorted spans: what each adds beyond the furthest end so far
    start = F.struct(F.lit(0).alias("far"), F.lit(0).cast("long").alias("n_hit"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct(F.greatest(acc["far"], end).alias("far"), (acc["n_hit"] + F.greatest(end - F.greatest(acc["far"], s["start"]), F.lit(0))).cast("long").alias("n_hit"))

    found = materialize(ends.select("text_key", F.aggregate("spans", start, add)["n_hit"].alias("n_hit"), "items"), "leak-found")
    n_found = found.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    out = counted.join(broadcast_if_small(found, n_found, BROADCAST_ROWS), "text_key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    items_sha = F.when(F.col("items").isNull(), F.lit(EMPTY_SHA256)).otherwise(F.sha2(F.array_join("items", ","), 256))
    return out.select("doc_id", "n_words", "n_hit", F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"), items_sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.drop("items")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, ns WHERE len(w) >= n)
), h AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw USING (n, g)
), c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY doc_id
), m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
