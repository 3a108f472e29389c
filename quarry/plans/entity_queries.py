"""Queries of mapping, resolution, quality, dedup and upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import entities, graph
from quarry.plans.registry import query
from quarry.session import shared_path
from quarry.sources.committed import CommittedTable, ingest


@query("mapped_events", "SELECT event_id AS id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    e = t("events").withColumnRenamed("props", "features")
    return entities.apply_mapping(e, {"kind": ("event_type", None), "k": ("features.k", None)}, [F.col("event_id").alias("id")])


GATE = "CASE WHEN a IS NULL OR b IS NULL THEN 'REJECT' WHEN c IS NULL OR d IS NULL THEN 'DEGRADE' ELSE 'PASS' END"
GATED = "SELECT c_custkey, c_name AS a, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS b, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS d FROM customer"


def _gated(t):
    k = F.col("c_custkey")
    c = t("customer").select("c_custkey", F.col("c_name").alias("a"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("b"), F.when(k % 3 != 0, F.col("c_name")).alias("c"), F.when(k % 5 != 0, F.col("c_name")).alias("d"))
    outcome, score = entities.gate(["a", "b"], ["c", "d"])
    return c.select("c_custkey", outcome.alias("outcome"), score.alias("completeness"))


@query("field_gate", f"SELECT c_custkey, {GATE} AS outcome, round(((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT) / 4.0::DOUBLE, 4) AS completeness FROM ({GATED})")
def _(t):
    return _gated(t)


@query("pipeline_counters", f"SELECT {GATE} AS outcome, count(*) AS cnt FROM ({GATED}) GROUP BY 1")
def _(t):
    return _gated(t).groupBy("outcome").agg(F.count("*").alias("cnt"))


@query("entity_merge_first_nonempty", """SELECT md5(text) AS k, arg_min(lang, doc_id) AS lang, arg_min(CASE WHEN doc_id % 3 <> 0 THEN source END, doc_id) FILTER (doc_id % 3 <> 0) AS source, count(*) AS n_rows FROM documents GROUP BY 1""")
def _(t):
    d = t("documents").select(F.md5(F.col("text").cast("binary")).alias("k"), "doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    return entities.merge_first(d, "k", "doc_id", ["lang", "source"])


@query("endpoint_resolution", "SELECT o_orderkey, coalesce(c.c_custkey::VARCHAR, 'name:' || regexp_replace(o.name, '[^A-Za-z0-9_-]', '_', 'g')) AS dst FROM (SELECT o_orderkey, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS name FROM orders) o LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0) c ON c.c_name = o.name")
def _(t):
    idx = t("customer").where("c_custkey % 4 <> 0").select(F.lit("org").alias("entity_type"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("entity_id"), "c_custkey")
    edges = t("orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("dst"))
    return entities.resolve_endpoints(edges, entities.name_index(idx, "c_custkey"), "dst", F.lit("org"))


@query("weak_name_clusters", """WITH p AS (SELECT p_partkey, p_name, p_brand FROM part), h AS (SELECT p_name, min(p_partkey) AS h FROM p GROUP BY 1)
 SELECT p.p_partkey, CASE WHEN p.p_partkey = h.h OR p.p_brand = q.p_brand THEN h.h ELSE p.p_partkey END AS head FROM p JOIN h USING (p_name) JOIN p q ON q.p_partkey = h.h""")
def _(t):
    p = t("part").select("p_partkey", "p_name", "p_brand")
    return entities.weak_clusters(p, ["p_name"], "p_partkey", lambda a, b: F.col(f"{a}p_brand") == F.col(f"{b}p_brand")).select("p_partkey", "head")


@query("dedup_documents", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def _(t):
    d = t("documents").select("doc_id", F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("raw_key"), F.md5(F.col("text").cast("binary")).alias("title_key"))
    return entities.dedup_documents(d).select("doc_id")


@query("dedup_keep_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def _(t):
    return entities.dedup_by_key(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_id")


def _snapshots(t):
    c = t("customer")
    old = c.where("c_custkey % 5 <> 0").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey") + 1).alias("c_nationkey"))
    return entities.upsert_with_log(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


SNAP = """WITH o AS (SELECT c_custkey, c_mktsegment AS m, c_nationkey AS n FROM customer WHERE c_custkey % 5 <> 0),
 w AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS m, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 END AS n FROM customer WHERE c_custkey % 2 = 0)"""


@query("profile_upsert", SNAP + " SELECT c_custkey, coalesce(w.m, o.m) AS c_mktsegment, coalesce(w.n, o.n) AS c_nationkey FROM o FULL JOIN w USING (c_custkey)")
def _(t):
    return _snapshots(t)[0]


@query("profile_upsert_diff", SNAP + """ SELECT * FROM (SELECT c_custkey, o.m IS NULL AS is_new, 'c_mktsegment' AS field, o.m AS old_value, coalesce(w.m, o.m) AS new_value FROM w LEFT JOIN o USING (c_custkey)
 UNION ALL SELECT c_custkey, o.m IS NULL, 'c_nationkey', o.n::VARCHAR, coalesce(w.n, o.n)::VARCHAR FROM w LEFT JOIN o USING (c_custkey)) WHERE old_value IS DISTINCT FROM new_value""")
def _(t):
    return _snapshots(t)[1]


@query("delete_entities", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def _(t):
    s = t("supplier")
    return entities.delete(s.select("s_suppkey"), "s_suppkey", s.where("s_nationkey < 5"))


@query("dq_index", """SELECT c_custkey, round(0.4::DOUBLE * least(greatest(c_acctbal / 10000, 0), 1) + 0.3::DOUBLE * least(greatest((0.9::DOUBLE + least(0.15::DOUBLE, 0.05::DOUBLE * ((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT))) * CASE WHEN c_custkey % 7 = 0 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 0), 1)
 + 0.3::DOUBLE * exp(-(c_custkey % 400) * 0.6931471805599453::DOUBLE / 180), 3) AS dq FROM customer""")
def _(t):
    k = F.col("c_custkey")
    today = F.lit("2024-06-01").cast("date")
    trust = S.source_trust(F.lit("ods_company_basic_info"), F.lit(""))
    bonus = S.authority_bonus(k % 2 == 0, k % 3 == 0)
    factor = S.consistency(F.when(k % 7 == 0, today).otherwise(F.date_sub(today, 1)), F.date_sub(today, 1))
    timely = S.timeliness(F.date_sub(today, (k % 400).cast("int")), today)
    complete = S.clamp(F.col("c_acctbal") / 10000)
    exact = S.QUALITY["completeness"] * complete + S.QUALITY["veracity"] * S.credibility(trust, bonus, factor) + S.QUALITY["timeliness"] * timely
    return t("customer").select("c_custkey", F.round(exact, 3).alias("dq"))


@query("entity_completeness", "SELECT s_suppkey, round((1.0::DOUBLE + (s_suppkey % 2 = 0)::INT + 0.5::DOUBLE * (s_suppkey % 3 = 0)::INT) / 2.5::DOUBLE, 4) AS completeness, round((1.0::DOUBLE + (s_suppkey % 2 = 0)::INT + 0.5::DOUBLE * (s_suppkey % 3 = 0)::INT) / 2.5::DOUBLE, 4) < 0.6 AS enrich FROM supplier")
def _(t):
    k = F.col("s_suppkey")
    s = t("supplier").select("s_suppkey", S.completeness([F.col("s_name").isNotNull(), k % 2 == 0], [k % 3 == 0]).alias("completeness"))
    return s.withColumn("enrich", F.col("completeness") < 0.6)


@query("latest_as_of", "SELECT o_custkey, max(d) AS as_of FROM (SELECT o_custkey, o_orderdate::DATE AS d FROM orders) WHERE d <= DATE '1997-06-30' GROUP BY 1")
def _(t):
    return entities.latest_date(t("orders"), "o_custkey", ["o_orderdate"], "1997-06-30").where("as_of is not null")


@query("stable_ids", "SELECT p_partkey, 'TECH_S_' || sha256('TECH::' || p_name || '::' || p_brand)[1:16] AS id FROM part")
def _(t):
    return t("part").select("p_partkey", S.stable_id("TECH", F.col("p_name"), F.col("p_brand")).alias("id"))


@query("date_formats", """SELECT o_orderkey, o_orderdate::DATE AS d FROM orders""")
def _(t):
    fmt = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy.M.d")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月 "), F.dayofmonth("o_orderdate"), F.lit("日")))
    return t("orders").select("o_orderkey", S.normalize_date(fmt).alias("d"))


@query("feedback_status", """SELECT user_id, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'revised' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status
 FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    e = t("events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("ts"))
    feedback = last.select("user_id", "ts", F.when(F.col("kind") == "click", "accept").when(F.col("kind") == "view", "revise").when(F.col("kind") == "error", "reject").alias("rating"))
    return entities.apply_feedback(e.select("user_id", F.lit("pending").alias("status")).distinct(), feedback, "user_id", ["ts"])


@query("record_keys", """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name || '|' || c_mktsegment END AS composite, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey END AS email FROM customer""")
def _(t):
    k = F.col("c_custkey")
    rows = t("customer").select("c_custkey", F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("full_name"), F.col("c_mktsegment").alias("employer"), F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("m"), k).alias("mail")))).alias("features"))
    keys = rows.select("c_custkey", entities.entity_keys([], F.col("features"), ["full_name", "employer"]).alias("keys"))
    return keys.select("c_custkey", F.col("keys")["full_name_employer"].alias("composite"), F.col("keys")["email"].alias("email"))


@query("entity_merge", """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, s_acctbal AS confidence FROM supplier),
 f AS (SELECT k - k % 5 AS k, arg_min(name, k) FILTER (name IS NOT NULL) AS name, max(confidence) AS confidence FROM s WHERE k % 5 <> 0 AND k - k % 5 IN (SELECT k FROM s) GROUP BY 1)
 SELECT s.k, coalesce(s.name, f.name) AS name, greatest(s.confidence, coalesce(f.confidence, s.confidence)) AS confidence, (s.name IS NULL AND f.name IS NOT NULL)::BIGINT + coalesce(f.confidence > s.confidence, FALSE)::BIGINT AS filled
 FROM s LEFT JOIN f ON s.k = f.k WHERE s.k % 5 = 0 OR s.k - s.k % 5 NOT IN (SELECT k FROM s)""")
def _(t):
    k = F.col("s_suppkey")
    rows = t("supplier").select(k.alias("k"), F.when(k % 3 != 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("confidence"))
    merged = rows.select(F.col("k").alias("from_id"), (F.col("k") - F.col("k") % 5).alias("to_id"))
    return entities.merge_entities(rows, merged, "k", ["name", "confidence"]).withColumn("filled", F.size("filled").cast("long"))


@query("gate_errors", f"SELECT c_custkey, 'gate' AS stage, repeat('missing ', 125) AS error_msg FROM ({GATED}) WHERE {GATE} = 'REJECT'")
def _(t):
    return entities.split_outcomes(_gated(t), F.repeat(F.lit("missing "), F.lit(200)), "gate")[1].select("c_custkey", "stage", "error_msg")


#: Documents of a hundred are a chain from the last to the first; those of every seventh hundred are a cycle, too.
MERGES = """m AS (SELECT doc_id AS from_id, CASE WHEN doc_id % 100 <> 0 THEN doc_id - 1 WHEN doc_id // 100 % 7 = 0 THEN doc_id + 99 END AS to_id FROM documents),
 r AS (SELECT from_id, to_id FROM m WHERE to_id IN (SELECT doc_id FROM documents)),
 e(id, tgt, n) AS (SELECT from_id, to_id, 1 FROM r UNION ALL SELECT e.id, r.to_id, n + 1 FROM e JOIN r ON r.from_id = e.tgt WHERE n < 100),
 s AS (SELECT id AS from_id, min(tgt) AS to_id FROM e GROUP BY 1)"""


def _merges(t):
    k = F.col("doc_id")
    to = F.when(k % 100 != 0, k - 1).when(F.floor(k / 100) % 7 == 0, k + 99)
    pairs = t("documents").select(k.alias("from_id"), to.alias("to_id"))
    return pairs.join(t("documents").select(k.alias("to_id")), "to_id", "left_semi")


@query("merge_closure", f"WITH RECURSIVE {MERGES} SELECT from_id, to_id FROM s WHERE from_id <> to_id")
def _(t):
    """Where chains and cycles of merges end."""
    return entities.survivors(_merges(t))


@query("entity_merge_closure", f"""WITH RECURSIVE {MERGES}, g AS (SELECT coalesce(s.to_id, doc_id) AS k, doc_id, CASE WHEN doc_id % 3 = 1 THEN source END AS name, n_chars AS confidence FROM documents LEFT JOIN s ON s.from_id = doc_id)
 SELECT k, coalesce(min(name) FILTER (doc_id = k), arg_min(name, doc_id) FILTER (name IS NOT NULL AND doc_id <> k)) AS name, max(confidence) AS confidence FROM g GROUP BY k""")
def _(t):
    """Entities after such merges."""
    k = F.col("doc_id")
    rows = t("documents").select(k.alias("k"), F.when(k % 3 == 1, F.col("source")).alias("name"), F.col("n_chars").alias("confidence"))
    return entities.merge_entities(rows, _merges(t), "k", ["name", "confidence"]).drop("filled")


@query("redirect_closure", f"WITH RECURSIVE {MERGES} SELECT DISTINCT source AS src, coalesce(to_id, doc_id) AS dst FROM documents LEFT JOIN s ON from_id = doc_id")
def _(t):
    """Edges to merged entities."""
    numbered = lambda c: F.format_string("d%012d", c)
    edges = t("documents").select(F.col("source").alias("src"), numbered(F.col("doc_id")).alias("dst"), F.lit("HAS").alias("rel"))
    merged = _merges(t).select(numbered(F.col("from_id")).alias("from_id"), numbered(F.col("to_id")).alias("to_id"))
    return graph.redirect(edges, merged).select("src", F.substring("dst", 2, 12).cast("long").alias("dst"))


@query("node_upsert", """WITH o AS (SELECT conv_id, role, arg_max(CASE WHEN length(text) >= 100 THEN md5(text) ELSE 'none' END, turn) AS v FROM conversations GROUP BY 1, 2),
 p AS (SELECT conv_id, role, v FROM o UNION ALL SELECT conv_id, 'seen', 'yes' FROM (SELECT DISTINCT conv_id FROM conversations))
 SELECT conv_id, string_agg(role || '=' || v, ';' ORDER BY role) AS properties FROM p WHERE v <> 'none' GROUP BY 1""")
def _(t):
    """Property maps of conversations, the last writer of each property wins, a short text removes it."""
    c = t("conversations")
    nodes = c.select("conv_id").distinct().select("conv_id", F.create_map(F.lit("seen"), F.lit("yes")).alias("properties"))
    updates = c.select("conv_id", "turn", F.create_map("role", F.when(F.length("text") >= 100, F.md5(F.col("text").cast("binary")))).alias("properties"))
    after = entities.upsert_properties(nodes, updates, "conv_id", "properties", ["turn"])
    pairs = F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return after.select("conv_id", F.array_join(pairs, ";").alias("properties"))


def _ingested(t):
    """Documents in two batches; the second comes twice, has keys twice and rows without a key."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    k = F.col("doc_id")
    table = CommittedTable(d.sparkSession, shared_path(d.sparkSession, "ingest"), "doc_id", d.schema)
    table.upsert(d.where(k % 3 != 0), "first", last=1)
    late = d.where(k % 2 == 0).withColumn("at", F.lit(1))
    again = late.where(k % 4 == 0).withColumns({"lang": F.lit("X"), "n_chars": F.lit(None).cast("long"), "at": F.lit(2)})
    batch = late.unionByName(again).unionByName(late.where(k % 100 == 0).withColumn("doc_id", F.lit(None).cast("long")))
    table.upsert(batch, "second", last=2, order="at")
    table.upsert(batch, "second", last=2, order="at")
    return table


@query("committed_ingest", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'X' ELSE lang END AS lang, CASE WHEN doc_id % 4 <> 0 OR doc_id % 3 <> 0 THEN n_chars END AS n_chars
 FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def _(t):
    """The state of a committed table after two batches."""
    return _ingested(t).rows()


@query("committed_log", """SELECT 1 AS version, field, count(*) AS n FROM documents, (VALUES ('lang'), ('n_chars')) f(field) WHERE doc_id % 3 <> 0 AND CASE field WHEN 'lang' THEN lang ELSE n_chars::VARCHAR END IS NOT NULL GROUP BY 2
 UNION ALL SELECT 2, 'lang', count(*) FROM documents WHERE doc_id % 2 = 0 AND CASE WHEN doc_id % 4 = 0 THEN 'X' ELSE lang END IS DISTINCT FROM CASE WHEN doc_id % 3 <> 0 THEN lang END AND (doc_id % 4 = 0 OR lang IS NOT NULL)
 UNION ALL SELECT 2, 'n_chars', count(*) FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0 AND n_chars IS NOT NULL""")
def _(t):
    """Its change log by version and field."""
    return _ingested(t).log().groupBy("version", "field").agg(F.count("*").alias("n"))


@query("committed_windows", "SELECT source, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(t):
    """Sources as the last of their documents has them, taken in key windows whose last key is committed with them."""
    d = t("documents").select("source", "lang", "n_chars", "doc_id")
    table = CommittedTable(d.sparkSession, shared_path(d.sparkSession, "windows"), "source", d.drop("doc_id").schema)
    ingest(table, d, "doc_id", -(-d.count() // 3), order="doc_id")
    return table.rows()
