"""Queries over graphs of suppliers, parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.plans.registry import query

EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'SUPPLIES' AS rel FROM lineitem)"


def _edges(t):
    return t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("rel")).distinct()


def _typed(t):
    n = F.col("s_nationkey")
    s = t("supplier").select(F.concat(F.lit("n"), n).alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("HAS").alias("rel"), F.concat(F.lit("a"), "s_suppkey").alias("eid"))
    r = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("HAS").alias("rel"), F.concat(F.lit("b"), "n_nationkey").alias("eid"))
    return s.unionByName(r)


TYPED = "e AS (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst, 'a' || s_suppkey AS eid FROM supplier UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'b' || n_nationkey FROM nation)"


@query("graph_neighbors", f"WITH {EDGES} SELECT node, rel FROM (SELECT dst AS node, rel FROM e WHERE src = 's1' UNION SELECT src, rel FROM e WHERE dst = 's1') ORDER BY node, rel LIMIT 100")
def _(t):
    return graph.neighbors(_edges(t), "s1", ["SUPPLIES"])


@query("graph_shortest_path", f"""WITH RECURSIVE {TYPED}, b AS (SELECT DISTINCT * FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
 p AS (SELECT 's3' AS here, ['s3'] AS path UNION ALL SELECT b.dst, list_append(path, b.dst) FROM p JOIN b ON b.src = p.here WHERE len(path) <= 4 AND NOT list_contains(path, b.dst)),
 f AS (SELECT path, len(path) - 1 AS depth FROM p WHERE here = 's10') SELECT path, depth::INT AS depth FROM f WHERE depth = (SELECT min(depth) FROM f) ORDER BY path LIMIT 5""")
def _(t):
    return graph.shortest_path(_typed(t), "s3", "s10", 4)


@query("graph_chain", f"""WITH {TYPED}, one AS (SELECT ['r1', dst] AS path, [eid] AS eids FROM e WHERE src = 'r1'),
 two AS (SELECT list_append(path, e.dst) AS path, list_append(eids, e.eid) AS eids FROM one JOIN e ON e.src = path[2])
 SELECT array_to_string(path, '>') AS path, depth FROM (SELECT *, len(eids)::INT AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two)) ORDER BY depth, eids LIMIT 200""")
def _(t):
    return graph.chain(_typed(t), "r1", ["HAS"], 2).select(F.array_join("path", ">").alias("path"), "depth")


@query("chain_edges", f"WITH {TYPED} SELECT eid FROM e WHERE src = 'r1' UNION SELECT e.eid FROM e o JOIN e ON e.src = o.dst WHERE o.src = 'r1'")
def _(t):
    return graph.chain_edges(graph.chain(_typed(t), "r1", ["HAS"], 2, limit=None))


@query("edge_upsert", f"WITH {EDGES} SELECT src, dst, rel FROM e WHERE src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey < 10) AND dst IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 25)")
def _(t):
    s = t("supplier").where("s_nationkey < 10").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    p = t("part").where("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.upsert_edges(_edges(t), s.union(p)).select("src", "dst", "rel")


@query("satellite_nodes", f"WITH {EDGES} SELECT src AS id, src AS name FROM e WHERE src NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey < 10) UNION SELECT dst, dst FROM e")
def _(t):
    nodes = t("supplier").where("s_nationkey < 10").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("org").alias("type"), F.col("s_name").alias("name"))
    return graph.with_satellites(nodes, _edges(t)).where("type = 'satellite'").select("id", "name")


@query("relation_redirect", f"WITH {EDGES} SELECT DISTINCT CASE WHEN substr(src, 2)::INT % 10 = 0 THEN 's1' ELSE src END AS src, dst, rel FROM e")
def _(t):
    merged = t("supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("from_id"), F.lit("s1").alias("to_id"))
    return graph.redirect(_edges(t), merged).select("src", "dst", "rel")


@query("structured_relations", "SELECT 'name:' || w AS src, 'p' || p_partkey AS dst, 'TECH_CONTRIBUTOR' AS rel FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def _(t):
    rows = t("part").select("p_partkey", F.regexp_replace("p_name", " ", ";").alias("authors"))
    return graph.structured_relations(rows, F.concat(F.lit("p"), "p_partkey"), F.col("authors"), "TECH_CONTRIBUTOR", "PERSON", "object", True).select("src", "dst", "rel")


@query("signal_network", "SELECT 'WS-' || s_suppkey AS src, 't' || x AS dst, 'same_domain' AS rel, 0.5::DOUBLE AS weight FROM (SELECT s_suppkey, unnest([s_nationkey, s_nationkey + 1]) AS x FROM supplier) UNION ALL SELECT 'WS-' || s_suppkey, 'o' || s_nationkey, 'funding', 0.8 FROM supplier")
def _(t):
    s = t("supplier").select(F.concat(F.lit("WS-"), "s_suppkey").alias("signal_id"), F.array(F.concat(F.lit("t"), "s_nationkey"), F.concat(F.lit("t"), F.col("s_nationkey") + 1)).alias("related_tech_ids"), F.array(F.concat(F.lit("o"), "s_nationkey")).alias("related_org_ids"))
    return graph.signal_network(s)


@query("taxonomy_edges", "SELECT DISTINCT 'ipc:' || chr((65 + p_size % 8)::INT) || lpad((p_size % 90 + 10)::VARCHAR, 2, '0') || 'T' AS src, p_brand AS dst FROM part")
def _(t):
    code = F.concat(F.char(65 + F.col("p_size") % 8), F.lpad((F.col("p_size") % 90 + 10).cast("string"), 2, "0"), F.lit("T7/00(2017.01)I"))
    return graph.taxonomy_edges(t("part").select(F.col("p_brand").alias("concept"), code.alias("ipc")))[1].select("src", "dst")


@query("rule_relations")
def _(t):
    text = F.concat(F.col("s_name"), F.lit("资助"), F.lit("项目"), F.col("s_suppkey").cast("string"), F.lit("开展研究。"))
    n = F.length("s_name")
    m = F.length(F.col("s_suppkey").cast("string"))
    spans = F.array(F.struct(F.lit("o").alias("entity_id"), F.lit("ORG").alias("entity_type"), (n * 0).alias("start"), n.alias("end")), F.struct(F.lit("p").alias("entity_id"), F.lit("PROJECT").alias("entity_type"), (n + 2).alias("start"), (n + 4 + m).alias("end")))
    return graph.rule_relations(t("supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"), spans.alias("spans")))
