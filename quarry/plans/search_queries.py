"""Queries of vector and keyword search, spans, chunks and text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import search, text_index, vector_index, words
from quarry.plans.registry import query

SIM = "SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _query_vector(t):
    return t("embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("knn_cosine", f"SELECT vec_id, round(sim, 9) AS sim FROM ({SIM}) ORDER BY sim DESC, vec_id LIMIT 20")
def _(t):
    return search.knn(t("embeddings"), _query_vector(t)).withColumn("sim", F.round("sim", 9))


@query("knn_filtered", "SELECT vec_id, round(sim, 9) AS sim FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3) ORDER BY sim DESC, vec_id LIMIT 10")
def _(t):
    return search.knn(t("embeddings"), _query_vector(t), 10, where=F.col("label") == 3).withColumn("sim", F.round("sim", 9))


@query("similarity_bands", f"SELECT CASE WHEN s >= 0.95 THEN 'auto' WHEN s >= 0.70 THEN 'judge' ELSE 'discard' END AS band, count(*) AS cnt FROM (SELECT (1 + sim) / 2 AS s FROM ({SIM})) GROUP BY 1")
def _(t):
    query_vector = F.array(*[F.lit(float(x)) for x in _query_vector(t)])
    hits = t("embeddings").select("vec_id", search.cosine(F.col("embedding"), query_vector).alias("sim"))
    return search.bands(hits, (1 + F.col("sim")) / 2).groupBy("band").agg(F.count("*").alias("cnt"))


BM = """SELECT doc_id, round({s}, 6) AS score FROM (SELECT *, avg(n) OVER () AS av, count(*) OVER () AS nd, count(*) FILTER (t0 > 0) OVER () AS d0, count(*) FILTER (t1 > 0) OVER () AS d1 FROM (SELECT doc_id, len(w)::DOUBLE AS n, len(list_filter(w, lambda x: x = 'idiot'))::DOUBLE AS t0, len(list_filter(w, lambda x: x = 'keit'))::DOUBLE AS t1 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents))) WHERE t0 > 0 OR t1 > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query("keyword_bm25", BM.format(s=" + ".join(f"ln(1 + (nd - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av))" for i in (0, 1))))
def _(t):
    return search.bm25(t("documents"), "doc_id", F.col("text"), ["idiot", "keit"])


@query("dual_retrieval", "SELECT k, max(score) AS score FROM (SELECT c_custkey AS k, round(c_acctbal, 2) AS score FROM customer WHERE c_nationkey = 3 UNION ALL SELECT o_custkey, round(o_totalprice / 100, 2) FROM orders) GROUP BY k")
def _(t):
    a = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("score"))
    b = t("orders").select(F.col("o_custkey").alias("k"), (F.round(F.col("o_totalprice") / 100 * 100) / 100).alias("score"))
    return search.merge_hits([a, b], "k")


@query("text_chunks", "SELECT doc_id, c::INT AS chunk, md5(substr(text, c * 4000 + 1, 4000)) AS piece_md5 FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 4000 + 1)) AS c FROM documents WHERE length(text) > 0)")
def _(t):
    return search.chunks(t("documents"), "doc_id", "text").select("doc_id", "chunk", F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


@query("best_spans", "SELECT o_custkey AS doc_id, o_orderpriority AS label, max(o_totalprice) AS confidence FROM orders GROUP BY 1, 2")
def _(t):
    s = t("orders").select(F.col("o_custkey").alias("doc_id"), F.lit("x").alias("text"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("confidence"), F.lit(0).alias("model_order"), F.col("o_orderkey").alias("start"))
    return search.best_spans(s).select("doc_id", "label", "confidence")


@query("span_selection")
def _(t):
    spans = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity") + 5).cast("int").alias("end"), F.col("l_discount").alias("confidence"))).alias("spans"))
    return spans.select("l_orderkey", F.size(search.select_spans(F.col("spans"))).alias("kept"), F.size("spans").alias("spans"))


@query("title_dedup_jaccard", """WITH h AS (SELECT p_name FROM part ORDER BY p_partkey DESC, p_name LIMIT 200)
 SELECT p_partkey, round(1 - max(len(list_intersect(list_distinct(string_split(p.p_name, '')), list_distinct(string_split(h.p_name, '')))) / len(list_distinct(list_concat(string_split(p.p_name, ''), string_split(h.p_name, ''))))::DOUBLE), 6) AS novelty
 FROM part p, h GROUP BY 1""")
def _(t):
    history = t("part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("at"))
    found = search.history_similarity(t("part").select("p_partkey", "p_name"), history, "p_partkey", "p_name")
    return found.withColumn("novelty", F.round("novelty", 6))


@query("name_overlap_score", """WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT w, max(p_size / 50.0::DOUBLE) AS s FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, p_size FROM part) WHERE length(w) > 1 GROUP BY 1)
 SELECT p_partkey, round(coalesce(max(s), (SELECT avg(p_size / 50.0::DOUBLE) * 0.5 FROM part)), 6) AS hot FROM w LEFT JOIN n ON w.w = n.w AND length(w.w) > 1 GROUP BY 1""")
def _(t):
    techs = t("part").select("p_name", (F.col("p_size") / 50.0).alias("fusion"))
    return search.title_overlap(t("part").select("p_partkey", "p_name"), techs, "p_name", "p_name", "fusion").select("p_partkey", F.round("hot", 6).alias("hot"))


@query("policy_keywords", "SELECT p_partkey, ((contains(p_name, 're'))::INT + (contains(p_name, 'an'))::INT + (contains(p_name, 'zz'))::INT) / 3.0::DOUBLE AS score FROM part")
def _(t):
    hits = [F.col("p_name").contains(k).cast("int") for k in ("re", "an", "zz")]
    return t("part").select("p_partkey", (sum(hits[1:], hits[0]) / 3.0).alias("score"))


@query("term_lists", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]+')))::INT AS n_terms FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("n_terms"))


@query("tfidf_keywords", """WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 1)) AS term FROM documents) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
 SELECT doc_id, term, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM (SELECT doc_id, term, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1), 6) AS score FROM tf JOIN df USING (term))) WHERE rank <= 5""")
def _(t):
    terms = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda x: F.length(x) > 1)
    return search.tfidf(t("documents").select("doc_id", terms.alias("terms")), "doc_id", "terms")


@query("context_pack", "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id) AS used FROM events) WHERE used <= 200 GROUP BY 1")
def _(t):
    packed = search.context_pack(t("events").select("user_id", "event_id", "props"), "user_id", "event_id", "props", 200)
    return packed.select("user_id", F.size(F.split("context", "\n")).cast("long").alias("n"))


@query("llm_cost", "SELECT event_id, ((event_id % 1000) * (CASE WHEN event_id % 2 = 0 THEN 4 ELSE 0 END) / 1000000.0)::DECIMAL(12, 6) AS cost FROM events")
def _(t):
    spark = t("region").sparkSession
    prices = spark.createDataFrame([("a", 4, 8)], "model string, price_in long, price_out long")
    calls = t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), F.lit(0).alias("tokens_out"))
    return search.llm_cost(calls, prices).select("event_id", "cost")


@query("tokens_by_language", "SELECT 'en' AS lang, sum(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 1 AND x NOT IN ('the', 'of', 'and'))))::BIGINT AS n FROM documents")
def _(t):
    d = t("documents").select(S.detect_lang(F.col("text")).alias("lang"), F.size(S.tokenize(F.col("text"), ["the", "of", "and"])).alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("n"))


TERMS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+(\+\+|#)?'), lambda x: x <> '')"


@query("keyword_index", f"""WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents), s AS (SELECT count(*) AS nd, avg(len(w)) AS av FROM d),
 tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 q AS (SELECT item_id, unnest(list_distinct({TERMS})) AS term FROM benchmark),
 s2 AS (SELECT item_id, doc_id, round(sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term), s GROUP BY 1, 2)
 SELECT item_id AS query, doc_id AS key, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s2) WHERE rank <= 20""")
def _(t):
    """The 20 best documents for each benchmark text, by an index of all documents (K3)."""
    index = text_index.build(t("documents"), "doc_id", "text")
    return text_index.search(index, t("benchmark"), "item_id", "text")


@query("knn_join", """SELECT q AS query, vec_id AS key, round(sim, 9) AS sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS q, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 20""")
def _(t):
    """The 20 nearest of all vectors to each query vector, all lists of the index being probed (K1, K5)."""
    index = vector_index.build(t("embeddings"), "vec_id", "embedding")
    return vector_index.nearest(index, t("embeddings").where("vec_id % 20 = 0"), "vec_id", "embedding")


@query("knn_index")
def _(t):
    """The same by codes and the lists that reach the recall (K1, K5)."""
    index = vector_index.build(t("embeddings"), "vec_id", "embedding")
    return vector_index.search(index, t("embeddings").where("vec_id % 20 = 0"), "vec_id", "embedding")


#: Words of six and more letters of the benchmark texts: a list bounded by that table.
LONG_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark)"


@query("many_keywords", f"SELECT doc_id, count(*) AS n FROM documents, ({LONG_WORDS}) WHERE contains(lower(text), w) GROUP BY 1")
def _(t):
    """How many of a long list of words each document contains, by one automaton."""
    listed = t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("w")).distinct()
    docs = t("documents").select("doc_id", F.lower("text").alias("lowered"))
    found = words.find_words(docs, "lowered", [r[0] for r in listed.collect()])
    return found.select("doc_id", F.size("words").cast("long").alias("n")).where("n > 0")


@query("word_segmentation")
def _(t):
    """Benchmark texts without their spaces cut into the commonest words of the documents."""
    counted = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("w")).where(F.length("w") <= words.LONGEST).groupBy("w").agg(F.count("*").alias("n"))
    listed = {r["w"]: r["n"] for r in counted.orderBy(F.desc("n"), "w").limit(20_000).collect()}  # a dictionary of fixed size
    texts = t("benchmark").select("item_id", F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "").alias("text"))
    return words.segment(texts, "text", listed).select("item_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5"))


INDUCED = """WITH p AS (SELECT unnest(string_split_regex(coalesce(text, ''), '[^\\p{L}\\p{N}]+')) AS part FROM benchmark), i AS (SELECT part, unnest(range(1, length(part) + 1)) AS pos FROM p WHERE part <> ''),
 r AS (SELECT part, pos, unnest(range(1, least(4, length(part) - pos + 1) + 1)) AS size FROM i), c AS (SELECT part[pos:pos + size - 1] AS run, CASE WHEN pos > 1 THEN part[pos - 1:pos - 1] ELSE '' END AS b, part[pos + size:pos + size] AS a FROM r),
 n AS (SELECT run, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 5), t AS (SELECT count(*) AS total FROM c WHERE length(run) = 1),
 k AS (SELECT run, n, unnest(range(1, length(run))) AS k FROM n WHERE length(run) > 1),
 h AS (SELECT k.run, any_value(k.n) AS n, min(ln(k.n::DOUBLE * total / (l.n::DOUBLE * q.n))) AS cohesion FROM k JOIN n l ON l.run = k.run[1:k] JOIN n q ON q.run = k.run[k + 1:], t GROUP BY 1),
 eb AS (SELECT run, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS e FROM (SELECT run, b, count(*) AS m FROM c GROUP BY 1, 2) GROUP BY 1), ea AS (SELECT run, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS e FROM (SELECT run, a, count(*) AS m FROM c GROUP BY 1, 2) GROUP BY 1)
 SELECT run AS word, n, round(cohesion, 6) AS cohesion, round(least(eb.e, ea.e), 6) AS freedom FROM h JOIN eb USING (run) JOIN ea USING (run) WHERE cohesion >= 1 AND round(least(eb.e, ea.e), 6) >= 0.5"""


@query("induced_words", INDUCED)
def _(t):
    """Runs of letters that hang together and stand freely."""
    return words.induced_words(t("benchmark"), F.col("text"))
