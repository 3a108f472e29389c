"""Records on their way in and out: renaming and coercion of fields, listings with filters, look-ups, batch writes with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import scalars as S
from quarry.operators import search, signals

#: Fields that hold lists, and parts of the names of date and organisation fields.
LIST_FIELDS = ["authors", "keywords", "ipc_codes", "institutions"]
DATE_PARTS = ["date", "time", "year"]
ORG_PARTS = ["org", "institution", "applicant"]
#: Fixed values of the impact score: weights, and counts at which each half is full.
IMPACT = {"orgs": (0.5, 20), "projects": (0.5, 50)}
#: What a verdict makes of a status.
VERDICTS = {"是": "validated", "否": "rejected"}
#: Relation types of the two viewpoints; any other viewpoint counts as evolve.
VIEWPOINTS = {"evolve": "TECH_EVOLVE", "prereq": "TECH_PREREQ"}

# --- projections ---


def rename_fields(df: DataFrame, fields: dict[str, str], keep: list[str], titles: list[str], title: str = "title") -> DataFrame:
    """Fields under their common names, all others in a map raw with keys raw_<name>; an empty title is the first of titles present.

    Of several fields for one name the first that is present counts, row by row."""
    lists = lambda c: isinstance(df.schema[c].dataType, T.ArrayType | T.MapType | T.StructType)
    sources: dict[str, list[str]] = {}
    for source, target in fields.items():
        if source in df.columns and target != title:
            sources.setdefault(target, []).append(source)
    known = [(F.col(own[0]) if len(own) == 1 else F.coalesce(*[F.when(S.has_value(F.col(c), df.schema[c].dataType.typeName()), F.col(c)) for c in own])).alias(target) for target, own in sources.items()]
    own = [F.col(source) for source, target in fields.items() if source in df.columns and target == title]
    fallback = [F.when(c.cast("string") != "", c.cast("string")) for c in [*own, *(F.col(t) for t in titles if t in df.columns)]]
    rest = [c for c in df.columns if c not in fields and c not in keep]
    pairs = [x for c in rest for x in (F.lit(f"raw_{c}"), F.to_json(c) if lists(c) else F.col(c).cast("string"))]
    raw = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*keep, F.coalesce(*fallback, F.lit(None).cast("string")).alias(title), *known, raw.alias("raw"))


def coerce(name: str, value: Column, is_list: bool = False) -> Column:
    """A field by its name: lists are cut at semicolons and trimmed, dates parsed where they can be, organisations and texts cleaned (P5)."""
    if name in LIST_FIELDS:
        between = "\u0001"  # lists are normalised as one text, as NFKC runs in Python
        parts = F.split(S.nfkc(F.array_join(value, between)), between) if is_list else F.split(value, ";")
        return F.filter(F.transform(parts, S.strip), lambda x: x != "")
    if any(part in name for part in DATE_PARTS):
        return F.coalesce(S.normalize_date(value.cast("string")).cast("string"), value.cast("string"))
    if any(part in name for part in ORG_PARTS):
        return S.normalize_org_name(value)
    return S.clean_text(value)


def query_text(*parts: Column) -> Column:
    """Names and summaries as one query of 500 characters at most."""
    return F.substring(F.concat_ws(" ", *(F.when(p != "", p) for p in parts)), 1, 500)


def entity_summary(columns: dict[str, Column], lists: list[str]) -> Column:
    """A line for each attribute present, lists cut to three, twenty lines at most."""
    value = lambda c: F.when(F.size(columns[c]) > 0, F.array_join(F.slice(columns[c], 1, 3), ", ")) if c in lists else F.when(columns[c].cast("string") != "", columns[c].cast("string"))
    lines = F.array_compact(F.array(*(F.concat(F.lit(f"  {c}: "), value(c)) for c in columns)))
    return F.array_join(F.slice(lines, 1, 20), "\n")


def plain_properties(df: DataFrame) -> DataFrame:
    """Columns that a property graph can hold: lists, maps and structs as JSON, other types than numbers, texts and booleans as text."""
    kept = (T.NumericType, T.StringType, T.BooleanType)
    nested = (T.ArrayType, T.MapType, T.StructType)
    typed = lambda f: F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name) if isinstance(f.dataType, kept) else F.col(f.name).cast("string")
    return df.select(*(typed(f).alias(f.name) for f in df.schema.fields))


# --- filters ---


def in_period(start: Column, end: Column, first: str | None, last: str | None) -> Column:
    """Whether a period lies within bounds, either of which may be missing (F8)."""
    out = F.lit(True)
    out = out & (start >= F.lit(first)) if first is not None else out
    return out & (end <= F.lit(last)) if last is not None else out


def listed(df: DataFrame, equal: dict[str, object], least: dict[str, float], newest: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows whose columns are as asked (a list stands for any of its values) and no smaller than asked, the newest first."""
    for c, v in equal.items():
        df = df.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v) if v is not None else df
    for c, v in least.items():
        df = df.where(F.col(c) >= v)
    out = df.orderBy(F.desc(newest), key)
    return out.limit(limit) if limit is not None else out


def known_value(value: Column, values: list[str], default: str | None = None) -> Column:
    """A value where it is one of the known ones, else the default."""
    return F.when(value.isin(values), value).otherwise(F.lit(default))


def known_values(values: Column, allowed: list[str]) -> Column:
    """The known values of a list."""
    return F.filter(values, lambda x: x.isin(allowed))


def confident(spans: Column, least: float = 0.7) -> Column:
    """Spans of at least a confidence."""
    return F.filter(spans, lambda s: s["confidence"] >= least)


# --- joins and look-ups ---


def with_names(df: DataFrame, ids: str, kind: str, names: DataFrame) -> DataFrame:
    """df with display_name: the name of each id within its type, the id where none is known (J3). names: type, id, name."""
    n = names.select(F.col("type").alias("_type"), F.col("id").alias("_id"), F.col("name").alias("_name")).dropDuplicates(["_type", "_id"])
    joined = df.join(n, (F.col(kind) == F.col("_type")) & (F.col(ids) == F.col("_id")), "left")
    return joined.select(*df.columns, F.coalesce(F.when(F.col("_name") != "", F.col("_name")), F.col(ids)).alias("display_name"))


def with_code_names(df: DataFrame, code: str, taxonomy: DataFrame, default: str) -> DataFrame:
    """df with code_name, that of the default code where the taxonomy (code, name) lacks the row's."""
    names = taxonomy.select(F.col("code").alias("_code"), F.col("name").alias("_code_name")).dropDuplicates(["_code"])
    fallback = names.where(F.col("_code") == default).agg(F.first("_code_name").alias("_default"))
    joined = df.join(names, F.col(code) == F.col("_code"), "left").join(F.broadcast(fallback))
    return joined.select(*df.columns, F.coalesce("_code_name", "_default").alias("code_name"))


def detail_features(found: DataFrame, profiles: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """The profiles of what a search found, with the number of rows of each child table, in one join each."""
    out = found.select(key).distinct().join(profiles, key)
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def terms_and_entities(tokens: Column, entities: Column) -> Column:
    """A document's tokens with its entities of more than one letter, each once."""
    return F.array_union(tokens, F.filter(entities, lambda e: F.length(e) > 1))


def first_distinct(values: Column, most: int = 50) -> Column:
    """The first distinct values in their order."""
    return F.slice(F.array_distinct(values), 1, most)


def distinct_concepts(df: DataFrame, document: str, concept: str) -> DataFrame:
    """Each concept once in a document."""
    return df.dropDuplicates([document, concept])


def new_peers(peers: Column, related: Column) -> Column:
    """Peers that are not related already."""
    return F.array_except(peers, F.coalesce(related, F.array().cast("array<string>")))


def whitelisted(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The columns that a table knows."""
    return df.select(*[c for c in df.columns if c in allowed])


# --- writes with counts ---


def create_records(new: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, log, counts) of a batch of new records: the first of each key that is not known yet is accepted and logged
    as field *; counts has accepted and skipped (W4, W5)."""
    marked = new.withColumn("_one", F.monotonically_increasing_id())
    first = marked.groupBy(key).agg(F.min("_one").alias("_one")).where(F.col(key).isNotNull())
    accepted = marked.join(first, [key, "_one"], "left_semi").join(known.select(key), key, "left_anti").drop("_one")
    log = accepted.select(key, F.lit("*").alias("field"), F.lit("create").alias("change"))
    counts = new.agg(F.count("*").alias("rows")).join(F.broadcast(accepted.agg(F.count("*").alias("accepted"))))
    return accepted, log, counts.select("accepted", (F.col("rows") - F.col("accepted")).alias("skipped"))


def write_triples(triples: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written, counts): triples (src, rel, dst, evidence) whose ends are nodes (id), evidence cut to 500 characters; written and failed."""
    ids = nodes.select("id").distinct()
    ok = triples.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    written = ok.where("rel is not null").withColumn("evidence", F.substring("evidence", 1, 500))
    counts = triples.agg(F.count("*").alias("rows")).join(F.broadcast(written.agg(F.count("*").alias("written"))))
    return written, counts.select("written", (F.col("rows") - F.col("written")).alias("failed"))


def verdict_status(verdict: Column, status: Column) -> Column:
    """The status that a verdict leads to; other verdicts leave it."""
    out = status
    for said, becomes in VERDICTS.items():
        out = F.when(verdict == said, becomes).otherwise(out)
    return out


def backfill_names(df: DataFrame, key: str, local: str, foreign: str, translated: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, log): the local name is the translated foreign one where only that is present, and each fill is logged."""
    fills = (F.coalesce(F.col(local), F.lit("")) == "") & (F.coalesce(F.col(foreign), F.lit("")) != "") & translated.isNotNull()
    log = df.where(fills).select(key, F.lit(local).alias("field"), F.col(local).alias("old_value"), translated.alias("new_value"))
    return df.withColumn(local, F.when(fills, translated).otherwise(F.col(local))), log


def status_counts(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row with the number of rows of each status."""
    return df.agg(*(F.count(F.when(F.col(status) == v, 1)).alias(v) for v in values))


def impact(orgs: Column, projects: Column) -> Column:
    """How far a topic reaches: half by its organisations, half by its projects."""
    counts = {"orgs": orgs, "projects": projects}
    orgs, projects = (w * F.least(F.coalesce(counts[c], F.lit(0)) / full, F.lit(1.0)) for c, (w, full) in IMPACT.items())
    return orgs + projects


def topic_impact(topics: DataFrame, key: str, orgs: DataFrame, projects: DataFrame) -> DataFrame:
    """topics with impact, from the rows that orgs and projects have of each."""
    o, p = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((orgs, "_orgs"), (projects, "_projects")))
    joined = topics.join(o, key, "left").join(p, key, "left")
    return joined.select(*topics.columns, impact(F.col("_orgs"), F.col("_projects")).alias("impact"))


def score_topics(topics: DataFrame, key: str, title: str, techs: DataFrame, keywords: list[str], orgs: DataFrame, projects: DataFrame, history: DataFrame) -> DataFrame:
    """Topics scored by all strategies and fused with their reviews (E5): score_hot by scored names (name, fusion), score_policy by
    the share of keywords in the title, score_impact by their organisations and projects, score_dedup by the history (title, at).

    topics has key, title, score_llm_gen and the four review_* columns, keys being unique; all joins are by key or by word."""
    hot = search.title_overlap(topics.select(key, title), techs, title, "name", "fusion").select(key, F.col("hot").alias("score_hot"))
    reach = topic_impact(topics.select(key), key, orgs, projects).withColumnRenamed("impact", "score_impact")
    new = search.history_similarity(topics.select(key, title), history, key, title).withColumnRenamed("novelty", "score_dedup")
    hits = [F.coalesce(F.contains(F.lower(title), F.lit(k.lower())), F.lit(False)).cast("int") for k in keywords]
    policy = F.least(sum(hits, F.lit(0)) / max(len(keywords), 1), F.lit(1.0))
    scored = topics.join(hot, key, "left").join(reach, key, "left").join(new, key, "left").withColumn("score_policy", policy)
    return scored.withColumn("final_score", signals.fuse_topic())


def untranslated(df: DataFrame, key: str, local: str, foreign: str, most: int = 5000) -> DataFrame:
    """Keys of records that have only a foreign name, the first of them in key order."""
    return df.where((F.coalesce(F.col(local), F.lit("")) == "") & (F.coalesce(F.col(foreign), F.lit("")) != "")).select(key).orderBy(key).limit(most)


def either(df: DataFrame, columns: list[str], value: object, key: str) -> DataFrame:
    """The first record, in key order, one of whose columns has a value."""
    return df.where(F.exists(F.array(*[F.col(c) == F.lit(value) for c in columns]), lambda x: x)).orderBy(key).limit(1)


# --- views of a graph, spans of several models ---


def viewpoint_edges(edges: DataFrame, viewpoint: str) -> DataFrame:
    """Edges of a viewpoint's relation type, with the viewpoint's name."""
    name = viewpoint if viewpoint in VIEWPOINTS else "evolve"
    return edges.where(F.col("rel") == VIEWPOINTS[name]).withColumn("viewpoint", F.lit(name))


def path_steps(paths: DataFrame, key: str, path: str = "path") -> DataFrame:
    """A row for each node of a path: its step, and the node before it."""
    out = paths.select(key, F.col(path).alias("_path"), F.posexplode(path).alias("step", "node"))
    return out.select(key, "step", F.when(F.col("step") > 0, F.get("_path", F.col("step") - 1)).alias("before"), "node")


def network_view(edges: DataFrame, order: str, names: DataFrame) -> DataFrame:
    """The nodes of edges (src, dst), each once, with the place of its first edge, whether it is met there as source, and its name (R8). names: id, name."""
    ends = edges.select(F.col("src").alias("node"), F.struct(F.col(order).alias("at"), F.lit(0).alias("end")).alias("_seen")).union(edges.select("dst", F.struct(F.col(order).alias("at"), F.lit(1).alias("end"))))
    first = ends.groupBy("node").agg(F.min("_seen").alias("_seen"))
    n = names.select(F.col("id").alias("node"), F.col("name").alias("_name")).dropDuplicates(["node"])
    joined = first.join(n, "node", "left")
    return joined.select("node", F.col("_seen.at").alias("first_edge"), (F.col("_seen.end") == 0).alias("as_source"), F.coalesce("_name", "node").alias("name"))


def ensemble(models: list[DataFrame], doc: str, least: float = 0.7) -> DataFrame:
    """Spans of several models (doc, text, label, start, end, confidence): the best of each text and label, without overlaps, of
    at least a confidence; a model without spans adds none (I2)."""
    if not models:
        raise ValueError("an ensemble needs the spans of one model at least; a model without any is an empty table")
    every = None
    for i, spans in enumerate(models):
        own = spans.withColumn("model_order", F.lit(i))
        every = own if every is None else every.unionByName(own)
    best = search.best_spans(every.withColumnRenamed(doc, "doc_id"))
    picked = best.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "confidence", "text", "label")).alias("spans"))
    return picked.select(F.col("doc_id").alias(doc), confident(search.select_spans(F.col("spans")), least).alias("spans"))
