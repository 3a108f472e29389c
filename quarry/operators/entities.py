"""Mapping, resolution, quality, dedup and upsert of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.session import checkpointed

Mapping = dict[str, tuple[str | Column, Callable[[Column], Column] | None]]


def apply_mapping(df: DataFrame, mapping: Mapping, keep: list[str] = ()) -> DataFrame:
    """Target columns from source columns, or JSON features named `features.x`, with optional transforms; blanks become null."""
    out = []
    for target, (source, transform) in mapping.items():
        c = source if isinstance(source, Column) else S.feature(F.col("features"), source.removeprefix("features.")) if source.startswith("features.") else F.col(source)
        c = transform(c) if transform else c
        out.append(c.alias(target))
    mapped = df.select(*keep, *out)
    strings = [f.name for f in mapped.schema if f.dataType.typeName() == "string" and f.name in mapping]
    return mapped.withColumns({n: F.when(S.strip(F.col(n)) != "", F.col(n)) for n in strings}) if strings else mapped


def gate(required: list[str], recommended: list[str]) -> tuple[Column, Column]:
    """(outcome, completeness) of a document: REJECT without a required field, DEGRADE without a recommended one, else PASS."""
    have = {c: S.has_value(F.col(c)) for c in [*required, *recommended]}
    everything = [h.cast("int") for h in have.values()]
    all_of = lambda cs: F.forall(F.array(*[have[c] for c in cs]), lambda x: x) if cs else F.lit(True)
    outcome = F.when(~all_of(required), "REJECT").when(~all_of(recommended), "DEGRADE").otherwise("PASS")
    score = F.round(F.aggregate(F.array(*everything), F.lit(0), lambda a, x: a + x) / len(everything), 4) if everything else F.lit(1.0)
    return outcome, score


def merge_first(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key: of each column the first value present, in the given order, and the number of rows."""
    first = [F.min_by(c, F.when(S.has_value(F.col(c), df.schema[c].dataType.typeName()), F.col(order))).alias(c) for c in columns]
    return df.groupBy(key).agg(*first, F.count("*").alias("n_rows"))


def weak_clusters(df: DataFrame, keys: list[str], order: str, same: Callable[[str, str], Column]) -> DataFrame:
    """Rows of equal keys joined to the group's head where the predicate holds, else on their own, as are rows with a null key (J15): adds head."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull()
    keyed = df.where(~blank)
    heads = keyed.groupBy(*keys).agg(F.min(order).alias("_h"))
    head_rows = keyed.select(*keys, *[F.col(c).alias(f"h_{c}") for c in df.columns if c not in keys])
    joined = keyed.join(heads, keys).join(head_rows, keys).where(F.col(f"h_{order}") == F.col("_h"))
    out = joined.withColumn("head", F.when((F.col(order) == F.col("_h")) | same("", "h_"), F.col("_h")).otherwise(F.col(order)))
    alone = df.where(blank).select(*df.columns, F.col(order).alias("head"))
    return out.select(*df.columns, "head").unionByName(alone)


def name_index(entities: DataFrame, order: str) -> DataFrame:
    """(entity_type, name, entity_id): the last writer wins."""
    return entities.groupBy("entity_type", "name").agg(F.max_by("entity_id", order).alias("entity_id"))


def resolve_endpoints(edges: DataFrame, index: DataFrame, column: str, entity_type: Column) -> DataFrame:
    """The id of a named endpoint, or its name id where the index has none."""
    i = index.select(F.col("entity_type").alias("_t"), F.col("name").alias("_n"), F.col("entity_id").alias("_id"))
    joined = edges.join(i, (entity_type == F.col("_t")) & (F.col(column) == F.col("_n")), "left")
    return joined.withColumn(column, F.coalesce("_id", S.name_id(F.col(column)))).drop("_t", "_n", "_id")


def dedup_documents(docs: DataFrame, id_column: str = "raw_key", title_column: str = "title_key", rank: str = "rank") -> DataFrame:
    """The sequential rule as rounds (D1): a row is kept if it is the first live row of both its id and its title; what it conflicts with goes.

    Dropped rows do not mark their keys. A null id and an empty or null title are no key. Every round keeps the first live row
    at least and is checkpointed; rounds go on until no row is live."""
    own = lambda c, none: F.when(none, F.struct(F.lit(None).cast("string").alias("key"), F.col(rank).cast("string").alias("row"))).otherwise(F.struct(F.col(c).cast("string").alias("key"), F.lit(None).cast("string").alias("row")))
    live = docs.select(own(id_column, F.col(id_column).isNull()).alias("_i"), own(title_column, F.coalesce(F.col(title_column), F.lit("")) == "").alias("_t"), rank)
    kept = None
    while True:
        first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(rank))
        winners = checkpointed(live.withColumn("_ni", first("_i")).withColumn("_nt", first("_t")).where("_ni = 1 and _nt = 1").select("_i", "_t", rank))
        kept = winners if kept is None else kept.unionByName(winners)
        live = live.join(winners.select("_i"), "_i", "left_anti").join(winners.select("_t"), "_t", "left_anti")
        # a key without a value is a struct with a null in it, which equals none: its row goes by rank
        live = checkpointed(live.join(winners.select(rank), rank, "left_anti").select("_i", "_t", rank))
        if live.isEmpty():
            return docs.join(kept.select(rank), rank, "left_semi")


def dedup_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def last_of_key(new: DataFrame, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row for each key, rows without a key): the last by order (W1), or of several without an order the greatest, so that a run repeats itself."""
    rows = new.where(F.col(key).isNotNull())
    rest = [c for c in new.columns if c not in (key, order)]
    last = F.max_by(F.struct(*new.columns), F.struct(*([order] if order else []), *rest)).alias("_row")
    return rows.groupBy(key).agg(last).select("_row.*"), new.where(F.col(key).isNull())


def upsert_with_log(old: DataFrame, new: DataFrame, key: str, columns: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows after the upsert, change log): values present replace old ones; the log has each field that changed.

    A key that is in new more than once counts with its last row (last_of_key); rows of new without a key are left out, and errors for the caller."""
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("_o"))
    kept = last_of_key(new.select(*dict.fromkeys([key, *columns, *([order] if order else [])])), key, order)[0]
    n = kept.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_n"))
    both = o.join(n, key, "full")
    after = both.select(key, *[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in columns])
    changed = both.where("_n").select(key, F.col("_o").isNull().alias("is_new"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").cast("string").alias("old_value"), F.coalesce(f"new_{c}", f"old_{c}").cast("string").alias("new_value")) for c in columns])).alias("x"))
    log = changed.select(key, "is_new", "x.*").where("not (old_value <=> new_value)")
    return after, log


def upsert_properties(nodes: DataFrame, updates: DataFrame, key: str, properties: str, order: list[str]) -> DataFrame:
    """Nodes (key, properties) after updates (key, properties, order) are folded into them in order: of each property the last writer wins.

    Properties are maps; one whose value is null is removed by it, as where a node is set to null. Nodes without updates stay, updates of new keys
    make nodes, rows without a key are left out. A property is one aggregate, so a node of very many updates is never gathered."""
    each = updates.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(1).alias("_new"), *order).alias("_order"), F.explode(properties).alias("_name", "_value"))
    blank = [F.lit(None).cast(updates.schema[c].dataType).alias(c) for c in order]
    old = nodes.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(0).alias("_new"), *blank).alias("_order"), F.explode(properties).alias("_name", "_value"))
    # a value in a struct, as a null is a value here; of equal order the greatest value
    last = each.unionByName(old).groupBy(key, "_name").agg(F.max_by(F.struct("_value"), F.struct("_order", "_value")).alias("_last"))
    pairs = last.where("_last._value is not null").groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_last._value")))).alias(properties))
    kind = nodes.schema[properties].dataType
    keys = nodes.select(key).unionByName(updates.select(key)).where(F.col(key).isNotNull()).distinct()
    return keys.join(pairs, key, "left").select(key, F.coalesce(F.col(properties), F.create_map().cast(kind)).alias(properties))


def delete(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


#: Attributes of which a merge keeps the greater value, or the later one.
GREATER = ["confidence", "completeness_score", "updated_at", "last_seen_at"]


def survivors(merged: DataFrame) -> DataFrame:
    """(from_id, to_id): for each record that merged (from_id, to_id) sends away, the one that is left at the end of its chain.

    Of several targets of a record the smallest counts. Of a cycle its smallest record is left, and records that lead into the cycle end there.
    Pairs of a record with itself or with null are no merge. Rounds double the distance looked ahead, so they grow with the logarithm of the longest
    chain; each is checkpointed, and rows stay one a record."""
    step = merged.where("from_id <> to_id").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("next"))
    step = checkpointed(step)

    def doubled(far: DataFrame) -> DataFrame:
        return checkpointed(far.join(far.select(F.col("id").alias("at"), F.col("at").alias("further")), "at", "left").select("id", F.coalesce("further", "at").alias("at")))

    def ahead(step: DataFrame) -> tuple[DataFrame, int]:
        """Where the chains of step (id, next) lead, and how many records are on or before a cycle; the records of cycles are where those lead."""
        far, before, walked = step.select("id", F.col("next").alias("at")), None, 1
        while True:
            open_ = far.join(step.select(F.col("id").alias("at")), "at", "left_semi").count()
            # every round ends chains while there are any that end; a walk as long as there are records on or before cycles is on one
            if not open_ or (open_ == before and walked >= open_):
                return far, open_
            before, far, walked = open_, doubled(far), 2 * walked

    far, cyclic = ahead(step)
    if cyclic:
        ends = far.join(step.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("at").alias("id")).distinct()
        ring = checkpointed(step.join(ends, "id", "left_semi"))
        # once round, each record of a cycle knows the least one
        low = ring.select("id", F.col("next").alias("at"), F.least("id", "next").alias("low"))
        for _ in range(ring.count().bit_length()):
            more = low.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("low").alias("lower"))
            low = checkpointed(low.join(more, "at").select("id", F.col("further").alias("at"), F.least("low", "lower").alias("low")))
        heads = low.select(F.col("low").alias("id")).distinct()
        far, _ = ahead(checkpointed(step.join(heads, "id", "left_anti")))
    return far.select(F.col("id").alias("from_id"), F.col("at").alias("to_id"))


def merge_entities(records: DataFrame, merged: DataFrame, key: str, columns: list[str], greater: list[str] = GREATER) -> DataFrame:
    """Records after those of merged (from_id, to_id) went into another one (I3, X45); edges are moved by graph.redirect.

    Chains and cycles end at one survivor. Its value stays unless it is empty, then the first present of its sources in id order fills it;
    attributes of greater keep the greatest. Adds filled (names of the attributes that changed). A pair without a record at one of its ends is
    no merge. Sources of a survivor are aggregated, so one with very many stays one row."""
    kind = {c: records.schema[c].dataType.typeName() for c in columns}
    ids = records.select(key).distinct()
    known = merged.join(ids.withColumnRenamed(key, "to_id"), "to_id", "left_semi").join(ids.withColumnRenamed(key, "from_id"), "from_id", "left_semi")
    known = survivors(known)
    pick = lambda c: F.max(c) if c in greater else F.min_by(c, F.when(S.has_value(F.col(c), kind[c]), F.col(key)))
    sources = records.join(known, F.col(key) == F.col("from_id")).groupBy("to_id").agg(*[pick(c).alias(f"_{c}") for c in columns])
    kept = records.join(known.select(F.col("from_id").alias(key)), key, "left_anti").join(sources.withColumnRenamed("to_id", key), key, "left")
    changed = {}
    for c in columns:
        more = S.has_value(F.col(f"_{c}"), kind[c])
        changed[c] = more & (~S.has_value(F.col(c), kind[c]) | ((F.col(f"_{c}") > F.col(c)) if c in greater else F.lit(False)))
    values = [F.when(changed[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns]
    return kept.select(*values, F.array_compact(F.array(*[F.when(changed[c], c) for c in columns])).alias("filled"))


#: Features that add a key to a record.
FEATURE_KEYS = {"mail": "email", "orcid_pub": "orcid", "doi": "doi", "Patent_number": "patent_number"}


def entity_keys(fields: list[str], features: Column, composite: list[str] | None = None) -> Column:
    """A map of the keys that identify a record (P2): fields that are present, or one key of all composite fields, joined by |, if
    none of them is empty; then keys from its features."""
    filled = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", c.cast("string"))
    if composite:
        own = {"_".join(composite): F.concat(*[x for c in composite for x in (F.lit("|"), filled(F.col(c)))][1:])}
    else:
        own = {c: filled(F.col(c)) for c in fields}
    # a feature's key comes after the record's own and wins
    found = {k: S.feature(features, f) for f, k in FEATURE_KEYS.items()}
    both = {k: F.coalesce(filled(found[k]), own.get(k, F.lit(None).cast("string"))) if k in found else own[k] for k in [*own, *(f for f in found if f not in own)]}
    return F.map_filter(F.create_map(*[x for k, v in both.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


#: The status that a rating gives to what was rated.
RATINGS = {"accept": "accepted", "reject": "rejected", "revise": "revised"}


def apply_feedback(topics: DataFrame, feedback: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """topics with the status that the last known rating gives, others as they are."""
    known = feedback.where(F.col("rating").isin(list(RATINGS)))
    last = known.groupBy(key).agg(F.max_by("rating", F.struct(*order)).alias("_rating"))
    became = F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair])[F.col("_rating")]
    return topics.join(last, key, "left").withColumn(status, F.coalesce(became, F.col(status))).select(*topics.columns)


def latest_date(df: DataFrame, key: str, dates: list[str], today: str) -> DataFrame:
    """The latest date of several columns and rows that is not in the future."""
    t = F.lit(today).cast("date")
    ok = [F.when(F.col(d).cast("date") <= t, F.col(d).cast("date")) for d in dates]
    return df.groupBy(key).agg(F.max(F.greatest(*ok) if len(ok) > 1 else ok[0]).alias("as_of"))


def quality_index(completeness: Column, veracity: Column, timeliness: Column) -> Column:
    return F.round(S.QUALITY["completeness"] * completeness + S.QUALITY["veracity"] * veracity + S.QUALITY["timeliness"] * timeliness, 4)


def split_outcomes(df: DataFrame, message: Column, stage: str, outcome: str = "outcome") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, error rows) of a gated table; an error has its stage and a message of 1,000 characters at most.

    A row without an outcome is an error."""
    bad = F.coalesce(F.col(outcome) == "REJECT", F.lit(True))
    return df.where(~bad), df.where(bad).select("*", F.lit(stage).alias("stage"), F.substring(message, 1, 1000).alias("error_msg"))
