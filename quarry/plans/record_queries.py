"""Queries of record mapping, listings, look-ups, batch writes, network views and span ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import records, rules
from quarry.plans.registry import query


@query("field_renaming", "SELECT p_partkey, p_name AS title, p_brand AS brand, p_type AS raw_type, (4 - (p_type IS NULL)::INT)::INT AS n_raw FROM part")
def _(t):
    found = records.rename_fields(t("part"), {"p_brand": "brand", "p_title": "title"}, ["p_partkey"], ["p_title", "p_name"])
    return found.select("p_partkey", "title", "brand", F.col("raw")["raw_p_type"].alias("raw_type"), F.size("raw").alias("n_raw"))


@query("field_coercion", """SELECT c_custkey, c_name || '|' || c_mktsegment AS authors, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-05' ELSE 'soon' END AS apply_date,
 replace(c_name || ' & Co', ' ', '') AS org_name, trim(c_name || ' ' || c_mktsegment) AS summary FROM customer""")
def _(t):
    c = t("customer")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    parts = {
        "authors": F.array_join(records.coerce("authors", F.concat(name, F.lit(" ;; "), segment, F.lit(" "))), "|"),
        "apply_date": records.coerce("apply_date", F.when(F.col("c_custkey") % 2 == 0, "2024/1/5").otherwise("soon")),
        "org_name": records.coerce("org_name", F.concat(name, F.lit(" & Co"))),
        "summary": records.coerce("summary", F.concat(F.lit(" "), name, F.lit(" \t  "), segment, F.lit("\x01"))),
    }
    return c.select("c_custkey", *(v.alias(k) for k, v in parts.items()))


@query("query_text", "SELECT doc_id, md5(substr(CASE WHEN text = '' THEN lang ELSE lang || ' ' || text END, 1, 500)) AS query_md5 FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def _(t):
    d = t("documents").where("lang is not null and text is not null")
    return d.select("doc_id", F.md5(records.query_text(F.col("lang"), F.col("text")).cast("binary")).alias("query_md5"))


@query("entity_summary", """SELECT s_suppkey, '  name: ' || s_name || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '  alias: n' || s_suppkey || chr(10) ELSE '' END || '  nation: ' || s_nationkey || chr(10) || '  tags: ' || array_to_string(['a', 'b', 'c'][1:(s_suppkey % 4 + 1)::INT], ', ') AS summary FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    alias = F.when(k % 2 == 0, F.concat(F.lit("n"), k)).otherwise("")
    columns = {"name": F.col("s_name"), "alias": alias, "nation": F.col("s_nationkey"), "tags": F.slice(F.array(*map(F.lit, "abcd")), 1, (k % 4 + 1).cast("int"))}
    return t("supplier").select("s_suppkey", records.entity_summary(columns, ["tags"]).alias("summary"))


@query("plain_properties", "SELECT n_nationkey, '[\"' || n_name || '\",\"x' || n_nationkey || '\"]' AS names, (DATE '2024-01-01' + n_nationkey::INT)::DATE::VARCHAR AS day FROM nation")
def _(t):
    k = F.col("n_nationkey")
    return records.plain_properties(t("nation").select("n_nationkey", F.array("n_name", F.concat(F.lit("x"), k)).alias("names"), F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")).alias("day")))


@query("frontier_list", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate + INTERVAL 30 DAY <= '1996-01-01'")
def _(t):
    end = F.col("o_orderdate") + F.expr("interval 30 days")
    return t("orders").where(records.in_period(F.col("o_orderdate"), end, "1995-01-01", "1996-01-01")).select("o_orderkey", "o_orderdate")


@query("alert_list", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value >= 50 ORDER BY ts DESC, event_id LIMIT 200")
def _(t):
    return records.listed(t("events"), {"event_type": "error", "user_id": None}, {"value": 50}, "ts", "event_id", 200).select("event_id", "value")


@query("decided_list", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id LIMIT 200")
def _(t):
    return records.listed(t("events"), {"event_type": ["error", "signup"]}, {}, "ts", "event_id", 200).select("event_id", "event_type")


@query("enum_cast", "SELECT CASE WHEN event_type IN ('error', 'signup') THEN event_type ELSE 'other' END AS kind, count(*) AS cnt, min(CASE WHEN event_type = 'error' THEN 'x' ELSE 'x,' || 'y' END) AS tags FROM events GROUP BY 1")
def _(t):
    kind = records.known_value(F.col("event_type"), ["error", "signup"], "other")
    tags = records.known_values(F.when(F.col("event_type") == "error", F.array(F.lit("x"), F.lit("z"))).otherwise(F.array(F.lit("x"), F.lit("z"), F.lit("y"))), ["x", "y"])
    return t("events").select(kind.alias("kind"), F.array_join(tags, ",").alias("tags")).groupBy("kind").agg(F.count("*").alias("cnt"), F.min("tags").alias("tags"))


@query("display_names", "SELECT o_orderkey, coalesce(c_name, 'c' || o_custkey) AS display_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 12")
def _(t):
    names = t("customer").where("c_nationkey < 12").select(F.lit("org").alias("type"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    o = t("orders").select("o_orderkey", F.lit("org").alias("kind"), F.concat(F.lit("c"), "o_custkey").alias("ref"))
    return records.with_names(o, "ref", "kind", names).select("o_orderkey", "display_name")


@query("taxonomy_names", "SELECT c_custkey, coalesce(n.n_name, (SELECT n_name FROM nation WHERE n_nationkey = 0)) AS code_name FROM customer LEFT JOIN nation n ON c_nationkey = n_nationkey AND n_regionkey < 3")
def _(t):
    taxonomy = t("nation").where("n_regionkey < 3 or n_nationkey = 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return records.with_code_names(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", taxonomy, "0").select("c_custkey", "code_name")


@query("detail_features", "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer WHERE c_acctbal > 0")
def _(t):
    found = t("customer").where("c_acctbal > 0").select("c_custkey")
    children = {"n_orders": t("orders").withColumnRenamed("o_custkey", "c_custkey")}
    return records.detail_features(found, t("customer").select("c_custkey", "c_name"), "c_custkey", children)


@query("term_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [p_brand]))), ',') AS terms FROM part")
def _(t):
    terms = records.terms_and_entities(F.split("p_name", " "), F.array("p_brand", F.lit("x")))
    return t("part").select("p_partkey", F.array_join(F.array_sort(records.first_distinct(terms)), ",").alias("terms"))


@query("concepts_of_documents", "SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def _(t):
    return records.distinct_concepts(t("lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("new_peers", """SELECT s_suppkey, array_to_string(list_filter(['n' || s_nationkey % 3, 'm', 's' || s_suppkey % 4], lambda p: CASE WHEN s_nationkey % 2 = 0 THEN p NOT IN ('n1', 's2') ELSE TRUE END), ',') AS peers FROM supplier""")
def _(t):
    nation, k = F.col("s_nationkey"), F.col("s_suppkey")
    kept = records.whitelisted(t("supplier"), ["s_suppkey", "s_nationkey"])
    peers = F.array(F.concat(F.lit("n"), nation % 3), F.lit("m"), F.concat(F.lit("s"), k % 4))
    related = F.when(nation % 2 == 0, F.array(F.lit("n1"), F.lit("s2")))
    return kept.select("s_suppkey", F.array_join(records.new_peers(peers, related), ",").alias("peers"))


@query("patent_rules", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CN' || (100000000 + o_orderkey) || 'A' END AS cn_patent_number, CASE WHEN o_orderkey % 3 = 1 THEN 'WO2020/' || (100000 + o_custkey) END AS wo_patent_number,
 CASE WHEN o_orderkey % 2 = 0 THEN 'A61B 5/0,G06F17/3' END AS ipc, o_orderdate::DATE AS application_date FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("no. cn"), 100000000 + k, F.lit("a of"))).when(k % 3 == 1, F.concat(F.lit("WO2020/"), 100000 + F.col("o_custkey")))
    fields = t("orders").select("o_orderkey", number.alias("title"), F.when(k % 2 == 0, "A61B 5/0; G06F17/3").alias("raw_IPC"), F.date_format("o_orderdate", "yyyy年M月d日").alias("application_date"))
    found = rules.extract(fields, "patent", ["o_orderkey"])
    return found.select("o_orderkey", "cn_patent_number", "wo_patent_number", F.array_join("ipc_codes", ",").alias("ipc"), "application_date")


@query("tender_rules", "SELECT s_suppkey, (s_suppkey * 1000 + 0.5)::DOUBLE AS budget_amount, DATE '2024-03-01' AS publish_date FROM supplier")
def _(t):
    s = t("supplier").select("s_suppkey", F.concat(F.lit("RMB "), F.format_number(F.col("s_suppkey") * 1000 + F.lit(0.5), 1)).alias("budget_amount"), F.lit("2024/03").alias("publish_date"))
    return rules.extract(s, "tender", ["s_suppkey"])


@query("bulk_import","SELECT count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)) AS accepted, count(*) - count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)) AS skipped FROM orders")
def _(t):
    new = t("orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    return records.create_records(new, t("customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("key")), "key")[2]


@query("triple_batch", "SELECT count(*) FILTER (s_nationkey < 15) AS written, count(*) FILTER (s_nationkey >= 15) AS failed FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    suppliers = t("supplier").where("s_nationkey < 15").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    nodes = suppliers.union(t("part").select(F.concat(F.lit("p"), "p_partkey")))
    triples = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.lit("SUPPLIES").alias("rel"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.repeat(F.lit("e"), F.lit(600)).alias("evidence"))
    return records.write_triples(triples, nodes)[1]


@query("verdict_status", "SELECT CASE WHEN event_id % 3 = 0 THEN 'validated' WHEN event_id % 3 = 1 THEN 'rejected' ELSE event_type END AS status, count(*) AS cnt FROM events GROUP BY 1")
def _(t):
    k = F.col("event_id") % 3
    verdict = F.when(k == 0, "是").when(k == 1, "否").otherwise("?")
    return t("events").groupBy(records.verdict_status(verdict, F.col("event_type")).alias("status")).agg(F.count("*").alias("cnt"))


@query("name_backfill", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'T ' || s_name END AS name FROM supplier")
def _(t):
    s = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, "").alias("name"), F.col("s_name").alias("name_en"))
    return records.backfill_names(s, "s_suppkey", "name", "name_en", F.concat(F.lit("T "), "name_en"))[0].select("s_suppkey", "name")


@query("outbox_counts", "SELECT count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\" FROM orders")
def _(t):
    return records.status_counts(t("orders"), "o_orderstatus", ["O", "F"])


@query("topic_impact", """SELECT n_nationkey, 0.5::DOUBLE * least(coalesce(o, 0) / 20.0::DOUBLE, 1) + 0.5::DOUBLE * least(coalesce(p, 0) / 50.0::DOUBLE, 1) AS impact FROM nation
 LEFT JOIN (SELECT s_nationkey AS k, count(*) AS o FROM supplier GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS p FROM customer GROUP BY 1) b ON b.k = n_nationkey""")
def _(t):
    orgs, projects = (t(name).select(F.col(c).alias("n_nationkey")) for name, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey")))
    return records.topic_impact(t("nation").select("n_nationkey"), "n_nationkey", orgs, projects)


@query("viewpoint_map", "SELECT 's' || l_suppkey AS src, 'prereq' AS viewpoint, count(*) AS cnt FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1")
def _(t):
    rel = F.when(F.col("l_linenumber") % 2 == 1, "TECH_PREREQ").otherwise("TECH_EVOLVE")
    edges = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), rel.alias("rel"))
    return records.viewpoint_edges(edges, "prereq").groupBy("src", "viewpoint").agg(F.count("*").alias("cnt"))


@query("path_steps", "SELECT s_suppkey, step::INT AS step, CASE step WHEN 1 THEN 'r' WHEN 2 THEN 'n' || s_nationkey END AS before, CASE step WHEN 0 THEN 'r' WHEN 1 THEN 'n' || s_nationkey ELSE 's' || s_suppkey END AS node FROM supplier, range(3) r(step)")
def _(t):
    path = F.array(F.lit("r"), F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"))
    return records.path_steps(t("supplier").select("s_suppkey", path.alias("path")), "s_suppkey")


@query("network_view", """WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_orderkey * 10 + l_linenumber AS seen FROM lineitem), x AS (SELECT src AS node, seen, true AS s FROM e UNION ALL SELECT dst, seen, false FROM e)
 SELECT node, min(seen) AS first_edge, bool_or(s) AS as_source, coalesce(min(s_name), node) AS name FROM x LEFT JOIN supplier ON node = 's' || s_suppkey GROUP BY node""")
def _(t):
    edges = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    names = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return records.network_view(edges, "at", names)


@query("span_ensemble", "SELECT o_orderkey, 1 + (o_orderkey % 2)::INT AS n, CASE WHEN o_orderkey % 3 = 2 THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM orders")
def _(t):
    k = F.col("o_orderkey")
    span = lambda a, b, c, x: t("orders").select("o_orderkey", F.lit(x).alias("text"), F.lit("ORG").alias("label"), F.lit(a).alias("start"), F.lit(b).alias("end"), c.alias("confidence"))
    # the second model is surer of alpha for a third of the orders, and of gamma for half of them
    sure = F.when(k % 3 == 2, 0.9).when(k % 3 == 1, 0.8).otherwise(0.7)
    models = [span(0, 5, F.lit(0.8), "alpha"), span(0, 5, sure, "alpha").union(span(3, 8, F.lit(0.85), "habet")).union(span(20, 25, F.when(k % 2 == 1, 0.8).otherwise(0.6), "gamma")), span(0, 0, F.lit(0.0), "").limit(0)]
    found = records.ensemble(models, "o_orderkey")
    return found.select("o_orderkey", F.size("spans").alias("n"), F.col("spans")[0]["confidence"].alias("confidence"))
