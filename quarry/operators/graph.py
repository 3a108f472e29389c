"""Property graph as nodes (id, type, name) and edges (src, dst, rel, eid): R1-R11, G22, W6-W9, J4, J7-J11 of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators.entities import survivors
from quarry.session import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def neighbors(edges: DataFrame, start: str, rels: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Nodes one undirected step from start (R2), ordered, at most limit."""
    one = undirected(edges).where(F.col("src") == start)
    if rels:
        one = one.where(F.col("rel").isin(rels))
    return one.select(F.col("dst").alias("node"), "rel").distinct().orderBy("node", "rel").limit(limit)


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = 4, limit: int = 5) -> DataFrame:
    """Shortest undirected paths of at most max_depth steps, as arrays of nodes, at most limit in order.

    A breadth-first search: each level joins the frontier once and drops nodes that an earlier level reached. Of the paths to a node the first limit
    in order stay, as any other that goes on from it comes after them: a level has no more than limit paths a node."""
    both = undirected(edges.select("src", "dst")).distinct()
    frontier = edges.sparkSession.range(1).select(F.lit(start).alias("at"), F.array(F.lit(start)).alias("path"))
    seen = frontier.select("at")
    for _ in range(max_depth):
        step = frontier.join(both, F.col("at") == F.col("src")).select(F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        first = F.row_number().over(Window.partitionBy("at").orderBy("path"))
        frontier = checkpointed(step.join(seen, "at", "left_anti").withColumn("_n", first).where(F.col("_n") <= limit).drop("_n"))
        found = frontier.where(F.col("at") == goal)
        if not found.isEmpty():
            return found.select("path", (F.size("path") - 1).alias("depth")).orderBy("path").limit(limit)
        seen = checkpointed(seen.unionByName(frontier.select("at")).distinct())
    return frontier.where("false").select("path", F.size("path").alias("depth"))


def chain(edges: DataFrame, start: str, rels: list[str], depth: int = 2, direction: str = "out", limit: int | None = 200) -> DataFrame:
    """Trails from start over typed edges, each edge once in a trail (R4): path, eids, depth; ordered, at most limit, or all of them, unordered, without one.

    Shorter trails come first, so where limit are found, longer ones are not looked for: a hub's trails are not extended for nothing."""
    typed = edges.where(F.col("rel").isin(rels)).select("src", "dst", "eid")
    steps = {"out": typed, "in": typed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "eid"), "both": undirected(typed)}[direction]
    trails = edges.sparkSession.range(1).select(F.array(F.lit(start)).alias("path"), F.array().cast(f"array<{dict(edges.dtypes)['eid']}>").alias("eids"))
    out = None
    for _ in range(max(1, min(depth, 4))):
        grown = trails.join(steps, (F.element_at("path", -1) == F.col("src")) & ~F.array_contains("eids", F.col("eid")))
        trails = checkpointed(grown.select(F.array_append("path", F.col("dst")).alias("path"), F.array_append("eids", F.col("eid")).alias("eids")))
        out = trails if out is None else out.unionByName(trails)
        if limit is not None and out.limit(limit).count() == limit:
            break
    out = out.withColumn("depth", F.size("eids"))
    return out if limit is None else out.orderBy("depth", "eids").limit(limit)


def chain_edges(trails: DataFrame) -> DataFrame:
    """Distinct edges of trails."""
    return trails.select(F.explode("eids").alias("eid")).distinct()


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends exist."""
    ids = nodes.select("id").distinct()
    one = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return one.dropDuplicates(["src", "dst", "rel"])


def with_satellites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with one more for each endpoint that is missing."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    more = ends.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("satellite").alias("type"), F.regexp_replace("id", "^name:", "").alias("name"))
    return nodes.select("id", "type", "name").unionByName(more)


def redirect(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after entities were merged (from_id into to_id, chains and cycles to their survivor): ends moved, loops and repeats gone."""
    m = survivors(merged)
    out = edges
    for end in ("src", "dst"):
        out = out.join(m.withColumnRenamed("from_id", end), end, "left").withColumn(end, F.coalesce("to_id", end)).drop("to_id")
    return out.where("src <> dst").dropDuplicates(["src", "dst", "rel"])


def structured_relations(rows: DataFrame, current: Column, field: Column, rel: str, other_type: str, current_as: str = "subject", is_list: bool = False) -> DataFrame:
    """Triples of one rule of a source table: the current entity and each name in a field."""
    names = F.explode(S.name_list(field)) if is_list else field
    named = rows.select(current.alias("cur"), names.alias("name")).where(S.has_value(F.col("name")))
    other = S.name_id(F.col("name"))
    src, dst = (F.col("cur"), other) if current_as == "subject" else (other, F.col("cur"))
    return named.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.lit(other_type).alias("other_type"), F.lit(1.0).alias("confidence"))


#: Subject type, object type, relation and trigger patterns of rule extraction, in order of priority.
TRIGGERS = [
    ("ORG", "ORG", "ORG_PARENT", "隶属于|归属于|属于.*下属|上级单位"),
    ("ORG", "ORG", "ORG_COOPERATE", "与.*合作|联合.*开展|共同.*签署"),
    ("ORG", "ORG", "ORG_FUND", "资助|拨款|给予.*经费"),
    ("ORG", "PROJECT", "ORG_FUND_PROJECT", "资助|立项|拨款.*项目|支持.*项目"),
    ("ORG", "PROJECT", "ORG_UNDERTAKE_PROJECT", "承担|承研|负责.*项目|执行.*项目"),
    ("ORG", "PERSON", "ORG_EMPLOY", "雇用|录用|任命|聘请|工作于"),
    ("PROJECT", "PERSON", "PROJECT_MANAGER", "负责人|项目负责人|主持人"),
    ("PROJECT", "PERSON", "PROJECT_RESEARCHER", "参与|研究人员|课题组成员"),
    ("PROJECT", "ORG", "PROJECT_MAIN_ORG", "主管单位|主管部门|归口管理"),
    ("PROJECT", "ORG", "PROJECT_UNDERTAKE_ORG", "承担单位|承研单位|依托单位"),
    ("PROJECT", "TECH", "PROJECT_INVOLVE_TECH", "研究.*技术|攻关.*技术|涉及.*技术|采用"),
    ("PERSON", "ORG", "PERSON_AFFILIATED_ORG", "就职于|任职于|供职于|工作在|研究员"),
    ("PERSON", "PROJECT", "PERSON_MANAGE_PROJECT", "主持|负责|担任.*负责人"),
    ("PERSON", "PROJECT", "PERSON_RESEARCH_PROJECT", "参与|研究|承担.*研究"),
    ("PERSON", "PERSON", "PERSON_COOPERATE", "与.*合作|联合.*发表|共同.*研究"),
    ("TECH", "ORG", "TECH_CONTRIBUTOR", "由.*研发|由.*开发|由.*发明"),
]
AROUND = 80


def rule_relations(docs: DataFrame, triggers: list[tuple[str, str, str, str]] = TRIGGERS) -> DataFrame:
    """Relations between span pairs of one document by trigger patterns (R11, J8, J10): docs (doc_id, text, spans of entity_id, entity_type, start, end)."""
    s = docs.select("doc_id", "text", F.explode("spans").alias("s"), "spans").select("doc_id", "text", "s", F.explode("spans").alias("o")).where("s <> o")
    gap_start, gap_end = F.least("s.end", "o.end"), F.greatest("s.start", "o.start")
    center = F.floor((F.col("s.start") + F.col("o.end")) / 2).cast("int")
    lo = F.when(gap_start > gap_end, F.greatest(center - AROUND, F.lit(0))).otherwise(F.greatest(gap_start - AROUND // 2, F.lit(0)))
    hi = F.when(gap_start > gap_end, center + AROUND).otherwise(gap_end + AROUND // 2)
    windowed = s.withColumn("window", F.substring("text", lo + 1, hi - lo))
    rel = F.lit(None).cast("string")
    for subject, obj, name, pattern in reversed(triggers):
        rel = F.when((F.col("s.entity_type") == subject) & (F.col("o.entity_type") == obj) & F.col("window").rlike(pattern), name).otherwise(rel)
    return windowed.withColumn("rel", rel).where("rel is not null").select("doc_id", F.col("s.entity_id").alias("src"), F.col("o.entity_id").alias("dst"), "rel", F.lit(0.75).alias("confidence"), F.substring("window", 1, 500).alias("evidence"))


#: Fixed weights of a signal's network edges.
NETWORK = {"related_tech_ids": ("same_domain", 0.5), "evidence_ids": ("co_occurrence", 1.0), "related_org_ids": ("funding", 0.8), "related_person_ids": ("authorship", 0.6)}


def signal_network(signals: DataFrame) -> DataFrame:
    """Edges from a signal to its related entities (R7); lists that are missing add none."""
    parts = [signals.select(F.col("signal_id").alias("src"), F.explode(c).alias("dst"), F.lit(kind).alias("rel"), F.lit(w).alias("weight")) for c, (kind, w) in NETWORK.items() if c in signals.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def taxonomy_edges(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(L1 nodes, TECH_CONTAINS edges) from concepts (concept, ipc): those whose subclass is known."""
    typed = codes.select("concept", S.ipc_subclass(F.col("ipc")).alias("sub"))
    nodes = typed.where("sub is not null").select(F.concat(F.lit("ipc:"), "sub").alias("id")).distinct()
    edges = typed.where("sub is not null").select(F.concat(F.lit("ipc:"), "sub").alias("src"), F.col("concept").alias("dst"), F.lit("TECH_CONTAINS").alias("rel")).distinct()
    return nodes, edges
