"""Queries of search, paging and statistics, over part, customer, orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profiles, records
from quarry.plans.registry import query

SINCE = "2024-01-15 00:00:00"


@query("stats_domain_distribution", "SELECT w AS value, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w ORDER BY cnt DESC, w LIMIT 20")
def _(t):
    return profiles.top_values(t("part").select(F.split("p_name", " ").alias("domains")), "domains", 20)


@query("stats_completeness_histogram", "SELECT CASE WHEN r < 0.3 THEN '0-0.3' WHEN r < 0.6 THEN '0.3-0.6' WHEN r < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS cnt FROM (SELECT p_size / 50.0::DOUBLE AS r FROM part) GROUP BY 1")
def _(t):
    return t("part").groupBy(profiles.histogram_bucket(F.col("p_size") / 50.0).alias("bucket")).agg(F.count("*").alias("cnt"))


def _log(t):
    e = t("events")
    return e.select(F.col("event_id").alias("change_id"), F.col("ts").alias("changed_at"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "signup", "*").otherwise(F.col("event_type")).alias("field"), F.when(F.col("event_id") % 3 == 0, "llm").otherwise("rule").alias("method"), F.when(F.col("user_id") % 2 == 0, "tech").otherwise("org").alias("entity_type"))


@query("stats_overview", f"""SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '{SINCE}' AND event_type = 'signup') AS new_this_period,
 count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '{SINCE}' AND event_type <> 'signup') AS updated_this_period,
 round(count(*) FILTER (event_id % 3 = 0) / count(*)::DOUBLE, 4) AS llm_ratio FROM events""")
def _(t):
    return profiles.overview(_log(t), F.col("entity_id"), SINCE)


@query("search_profiles", """SELECT p_partkey, p_name, p_type FROM part WHERE (p_name ILIKE '%re%' OR p_brand ILIKE '%re%')
 AND list_has_any(string_split(p_name, ' '), (SELECT list(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey <= 3)))
 ORDER BY p_partkey LIMIT 20 OFFSET 20""")
def _(t):
    part = t("part").withColumn("domains", F.split("p_name", " "))
    wanted = [r[0] for r in part.where("p_partkey <= 3").select(F.explode("domains").alias("w")).distinct().collect()]
    found = part.where(profiles.search_predicate("re", ["p_name", "p_brand"], wanted, "domains"))
    return profiles.page(found, [F.col("p_partkey")], 2, 20).select("p_partkey", "p_name", "p_type")


@query("search_total", "SELECT count(*) AS total FROM part WHERE p_name ILIKE '%re%' AND p_size >= 10 AND p_size <= 40")
def _(t):
    return t("part").where(profiles.search_predicate("re", ["p_name"]) & F.col("p_size").between(10, 40)).agg(F.count("*").alias("total"))


@query("search_date_range", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE >= DATE '1996-01-01' AND o_orderdate::DATE <= DATE '1996-02-15' ORDER BY o_orderkey LIMIT 50")
def _(t):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    found = o.where(profiles.search_predicate(date_column="d", date_from="1996-01-01", date_to="1996-02-15"))
    return profiles.page(found, [F.col("o_orderkey")], 1, 50).select("o_orderkey", "d")


@query("change_feed", "SELECT event_id AS change_id, ts AS changed_at, user_id AS entity_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    return profiles.change_feed(_log(t), "2024-01-10", "2024-01-20", "tech", 100).select("change_id", "changed_at", "entity_id")


@query("change_feed_total", "SELECT count(*) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND user_id % 2 = 0")
def _(t):
    return _log(t).where("changed_at >= timestamp'2024-01-10' and changed_at <= timestamp'2024-01-20' and entity_type = 'tech'").agg(F.count("*").alias("total"))


@query("value_distribution", """SELECT 'event_type' AS field, event_type AS value, count(*) AS cnt, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS ratio, 1.0::DOUBLE AS coverage
 FROM events GROUP BY event_type ORDER BY cnt DESC, value LIMIT 20""")
def _(t):
    return profiles.value_distribution(t("events"), "event_type")


@query("multi_distribution", """WITH u AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part),
 c AS (SELECT field, value, count(*) AS cnt FROM u GROUP BY ALL)
 SELECT field, value, cnt, rk FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY cnt DESC, value) AS rk FROM c) WHERE rk <= 5""")
def _(t):
    from pyspark.sql import Window

    long = t("part").unpivot([], ["p_brand", "p_type"], "field", "value")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("cnt"), "value"))
    return counts.withColumn("rk", rank).where("rk <= 5")


@query("ingest_task_stats", "SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS failed, greatest(count(*) - count(*) FILTER (l_linestatus = 'F'), 0) AS success FROM lineitem GROUP BY 1")
def _(t):
    return profiles.task_stats(t("lineitem"), "l_returnflag", F.col("l_linestatus") == "F")


@query("count_by_type", """WITH k AS (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus), c AS (SELECT k.o_orderstatus, count(o.o_orderkey) AS cnt FROM k LEFT JOIN orders o USING (o_orderstatus) GROUP BY 1)
 SELECT * FROM c UNION ALL SELECT 'total', sum(cnt)::BIGINT FROM c""")
def _(t):
    return profiles.count_by_type(t("orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("profile_with_children", """SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, coalesce(round(sum(o.o_totalprice), 2), 0) AS total, coalesce(min(o.o_orderkey), -1) AS first_order
 FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def _(t):
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    nested = profiles.with_children(t("customer").select("c_custkey"), "c_custkey", {"orders": orders})
    total = F.aggregate("orders", F.lit(0.0), lambda a, o: a + o["o_totalprice"])
    return nested.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.round(total, 2).alias("total"), F.coalesce(F.try_element_at("orders", F.lit(1))["o_orderkey"], F.lit(-1)).alias("first_order"))


@query("id_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey <= 100)")
def _(t):
    ids = t("orders").where("o_orderkey <= 100").select(F.col("o_custkey").alias("c_custkey"))
    return profiles.lookup(t("customer").select("c_custkey", "c_name"), "c_custkey", ids)


@query("untranslated_scan", "SELECT c_custkey FROM customer WHERE (nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name END, '') IS NULL) AND c_name <> '' ORDER BY c_custkey LIMIT 5000")
def _(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("cn"), F.col("c_name").alias("en"))
    return records.untranslated(c, "c_custkey", "cn", "en")


@query("latest_config", "SELECT s_suppkey, s_name FROM supplier ORDER BY (s_nationkey = 3) DESC, s_suppkey DESC LIMIT 1")
def _(t):
    return t("supplier").orderBy(F.desc(F.col("s_nationkey") == 3), F.desc("s_suppkey")).select("s_suppkey", "s_name").limit(1)


@query("list_by_type", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return profiles.page(t("orders").where("o_orderstatus = 'F'"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 25).select("o_orderkey", "o_totalprice")


@query("disjunctive_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 OR o_custkey = 7 ORDER BY o_orderkey LIMIT 1")
def _(t):
    return records.either(t("orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], 7, "o_orderkey")


@query("type_rollup", "SELECT coalesce(p_brand, 'all') AS p_brand, coalesce(p_type, 'all') AS p_type, count(*) AS cnt FROM part GROUP BY ROLLUP (p_brand, p_type)")
def _(t):
    return t("part").rollup("p_brand", "p_type").agg(F.count("*").alias("cnt")).select(F.coalesce("p_brand", F.lit("all")).alias("p_brand"), F.coalesce("p_type", F.lit("all")).alias("p_type"), "cnt")
