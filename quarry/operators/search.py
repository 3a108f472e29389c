"""Vector and keyword search, merging of hits, span selection and text chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.session import checkpointed, small, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn(vectors: DataFrame, vector: list[float], k: int = 20, key: str = "vec_id", column: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest rows to one query vector by cosine (K1, K2), ties by key."""
    kept = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in vector])
    return kept.select(key, cosine(F.col(column), q).alias("sim")).orderBy(F.desc("sim"), key).limit(k)


def bm25(docs: DataFrame, key: str, text: Column, terms: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for query terms by BM25 (K3), whatever their case; for many queries, and for all scripts, there is text_index.

    Words are runs of a-z and 0-9; other characters of a term stand for themselves, so c++ finds c++ and not c."""
    return _best(docs, key, [(text, 1.0)], terms, k, k1, b)


def best_field(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents by the best of their fields, each field's BM25 being multiplied by its weight (K3)."""
    return _best(docs, key, [(F.col(c), w) for c, w in fields.items()], terms, k, k1, b)


def _best(docs: DataFrame, key: str, fields: list[tuple[Column, float]], terms: list[str], k: int, k1: float, b: float) -> DataFrame:
    # the counts of words are written, so that texts are read once and statistics and scores are taken from narrow rows
    counts, patterns = [], []
    for term in terms:
        term = term.lower()
        # the term ends where its kind of character ends
        edge = lambda c: r"[a-z0-9]" if re.match("[a-z0-9]", c) else re.escape(c)
        patterns.append(f"(?<!{edge(term[0])}){re.escape(term)}(?!{edge(term[-1])})" if term else "(?!)")
    for f, (text, _) in enumerate(fields):
        lowered = F.lower(F.coalesce(text, F.lit("")))
        counts.append(F.regexp_count(lowered, F.lit("[a-z0-9]+")).alias(f"n{f}"))
        counts += [F.regexp_count(lowered, F.lit(p)).alias(f"tf{f}_{i}") for i, p in enumerate(patterns)]
    rows = checkpointed(docs.select(key, *counts))
    pairs = [(f, i) for f in range(len(fields)) for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("docs"), *[F.avg(f"n{f}").alias(f"avg{f}") for f in range(len(fields))], *[F.count_if(F.col(f"tf{f}_{i}") > 0).alias(f"df{f}_{i}") for f, i in pairs])
    joined = rows.where(" or ".join(f"tf{f}_{i} > 0" for f, i in pairs)).join(F.broadcast(stats))
    scores = []
    for f, (_, weight) in enumerate(fields):
        score = F.lit(0.0)
        for i in range(len(terms)):
            tf, df = F.col(f"tf{f}_{i}"), F.col(f"df{f}_{i}")
            idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
            score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"n{f}") / F.col(f"avg{f}")))).otherwise(0.0)
        scores.append(weight * score)
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return joined.select(key, F.round(best, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def merge_hits(hits: list[DataFrame], key: str, score: str = "score") -> DataFrame:
    """Hits of several searches, the best score of each document, best first."""
    union = hits[0]
    for h in hits[1:]:
        union = union.unionByName(h)
    return union.groupBy(key).agg(F.max(score).alias(score)).orderBy(F.desc(score), key)


def bands(hits: DataFrame, score: Column, auto: float = 0.95, judge: float = 0.70) -> DataFrame:
    return hits.withColumn("band", S.band(score, auto, judge))


def best_spans(spans: DataFrame) -> DataFrame:
    """The best span of each (doc_id, text, label) by confidence, the first model's where equal."""
    w = Window.partitionBy("doc_id", "text", "label").orderBy(F.desc("confidence"), "model_order", "start")
    return spans.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def select_spans(spans: Column) -> Column:
    """Of an array of spans (start, end, confidence, ...) those chosen greedily by confidence, then start, without overlap."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(F.signum((a["start"] - b["start"]).cast("double")).cast("int")))
    none = F.filter(spans, lambda s: F.lit(False))
    chosen = F.aggregate(ordered, none, lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.array_append(kept, s)))
    return F.array_sort(chosen, lambda a, b: F.signum((a["start"] - b["start"]).cast("double")).cast("int"))


def chunks(df: DataFrame, key: str, text: str, size: int = 4000) -> DataFrame:
    """Pieces of a fixed number of characters."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    return df.select(key, F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).alias("chunk", "piece"))


def context_pack(hits: DataFrame, query: str, rank: str, text: str, budget: int = 4000) -> DataFrame:
    """Texts of each query in rank order until the first that would exceed a budget of characters."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget).groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda s: s[text]), "\n").alias("context"))


def title_overlap(titles: DataFrame, techs: DataFrame, title: str, name: str, score: str) -> DataFrame:
    """The best score of a technology one of whose name's words (over one letter) is in the title; half the mean without any.

    techs is a list of scored names and is joined by word, so titles meet only names that share a word with them."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) > 1))
    t = titles.withColumn("_row", F.monotonically_increasing_id()).withColumn("_w", F.explode_outer(words(F.col(title))))
    n = techs.select(F.explode(words(F.col(name))).alias("_w"), F.col(score).alias("_s")).groupBy("_w").agg(F.max("_s").alias("_s"))
    mean = techs.agg((F.avg(score) * 0.5).alias("_m"))
    return t.join(n, "_w", "left").groupBy("_row", *titles.columns).agg(F.max("_s").alias("_s")).join(F.broadcast(mean)).select(*titles.columns, F.coalesce("_s", "_m", F.lit(0.0)).alias("hot"))


def history_similarity(titles: DataFrame, history: DataFrame, key: str, title: str, latest: int = 200) -> DataFrame:
    """1 less the greatest character Jaccard with any of the latest titles of the history (J14, D7); the history is a list of fixed length."""
    letters = lambda c: F.array_distinct(F.split(c, ""))
    # the letters of each title are split once, and those of equal sets of letters compared once
    old = history.orderBy(F.desc("at"), "title").limit(latest).agg(F.collect_set(F.array_sort(letters(F.col("title")))).alias("_old"))
    own = titles.select(key, F.array_sort(letters(F.col(title))).alias("_own"))
    best = F.array_max(F.transform("_old", lambda o: S.jaccard_of(F.col("_own"), o)))
    scored = own.select("_own").distinct().join(F.broadcast(old)).select("_own", (1 - F.coalesce(best, F.lit(0.0))).alias("novelty"))
    return own.join(scored.withColumnRenamed("_own", "_set"), F.col("_own").eqNullSafe(F.col("_set"))).select(key, "novelty")


def tfidf(docs: DataFrame, key: str, terms: str, k: int = 5) -> DataFrame:
    """The k terms of each document with the greatest tf * ln((1 + n) / (1 + df)) + tf (X15), ties by term."""
    # counted once and written, for the statistics and for the scores
    tf = written(docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "term-counts")
    df = small(tf.groupBy("term").agg(F.count("*").alias("df")), 300_000)
    n = docs.agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1), 6))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "term", "score", "rank")


def textrank(docs: DataFrame, key: str, terms: str, k: int = 5, span: int = 5, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """The k best words of each document by rank in the graph of words that stand within span words of one another (X15), ties by word.

    Documents are independent: a round joins a document's words with its edges, both dealt by document and word. Rows of terms
    share their document's key; a document without two different words has no graph and no row. Rounds are fixed in number,
    as in the original, and written every few rounds."""
    n = F.size("_terms")
    near = docs.select(key, F.col(terms).alias("_terms"), F.posexplode(terms).alias("_at", "src"))
    near = near.select(key, "src", F.explode(F.slice("_terms", F.col("_at") + 2, F.least(F.lit(span - 1), n))).alias("dst")).where("src <> dst")
    both = near.union(near.select(key, F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = both.groupBy(key, "src", "dst").agg(F.count("*").cast("double").alias("w"))
    out = edges.groupBy(key, "src").agg(F.sum("w").alias("out"))
    share = checkpointed(edges.join(out, [key, "src"]).select(key, "src", "dst", (F.col("w") / F.col("out")).alias("share")))
    rank = share.select(key, F.col("src").alias("term")).distinct().withColumn("score", F.lit(1.0))
    for i in range(rounds):
        given = share.join(rank.withColumnRenamed("term", "src"), [key, "src"]).select(key, F.col("dst").alias("term"), (F.col("share") * F.col("score")).alias("got"))
        rank = given.groupBy(key, "term").agg((1 - damping + damping * F.sum("got")).alias("score"))
        rank = checkpointed(rank) if i % 5 == 4 else rank
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term")
    return rank.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "term", F.round("score", 6).alias("score"), "rank")


def llm_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from its tokens and the model's price for a million (G25); unknown models cost nothing, of several prices the greatest counts."""
    one = prices.groupBy("model").agg(F.max(F.struct("price_in", "price_out")).alias("_p")).select("model", "_p.*")
    joined = calls.join(small(one), "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0))) / 1_000_000
    return joined.select(*calls.columns, cost.cast("decimal(12,6)").alias("cost"))
