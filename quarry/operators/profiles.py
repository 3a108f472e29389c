"""Search, change feed and statistics over entity profiles (F1-F15, G1-G14, T1-T11, P6-P8 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_predicate(keyword: str | None = None, text_columns: list[str] = (), domains: list[str] | None = None, domain_column: str | None = None, date_column: str | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """The conjunction of the optional search conditions (F1-F4); `%` and `_` of a keyword are wildcards."""
    parts = []
    if keyword:
        parts.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{keyword}%") for c in text_columns]))
    if domains:
        parts.append(F.arrays_overlap(F.col(domain_column), F.array(*map(F.lit, domains))))
    if date_from:
        parts.append(F.col(date_column) >= F.lit(date_from).cast("date"))
    if date_to:
        parts.append(F.col(date_column) <= F.lit(date_to).cast("date"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def change_feed(log: DataFrame, since: str, until: str | None, entity_type: str | None, n: int, time: str = "changed_at", key: str = "change_id") -> DataFrame:
    """Latest changes of a type within [since, until] (F5, T3), newest first, key breaking ties."""
    kept = log.where(F.col(time) >= F.lit(since).cast("timestamp"))
    if until:
        kept = kept.where(F.col(time) <= F.lit(until).cast("timestamp"))
    if entity_type:
        kept = kept.where(F.col("entity_type") == entity_type)
    return kept.orderBy(F.desc(time), F.asc(key)).limit(n)


def lookup(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def histogram_bucket(ratio: Column) -> Column:
    return F.when(ratio < 0.3, "0-0.3").when(ratio < 0.6, "0.3-0.6").when(ratio < 0.8, "0.6-0.8").otherwise("0.8-1.0")


def top_values(df: DataFrame, values: str, k: int = 20) -> DataFrame:
    """The k commonest elements of an array column with their counts (G5, T4); ties by value."""
    return df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "value").limit(k)


def value_distribution(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Top values of a scalar or array column with coverage (share of rows with a value) and ratio of all occurrences."""
    is_array = df.schema[column].dataType.typeName() == "array"
    present = (F.size(column) > 0) if is_array else F.col(column).isNotNull()
    totals = df.agg(F.count("*").alias("total"), F.count_if(present).alias("present"))
    values = df.where(present).select((F.explode(column) if is_array else F.col(column)).cast("string").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("cnt"))
    occurrences = counts.agg(F.sum("cnt").alias("occurrences"))
    top = counts.orderBy(F.desc("cnt"), "value").limit(k)
    one = totals.join(F.broadcast(occurrences))  # two tables of one row each
    return top.join(F.broadcast(one)).select(F.lit(column).alias("field"), "value", "cnt", F.round(F.col("cnt") / F.col("occurrences"), 4).alias("ratio"), F.round(F.col("present") / F.col("total"), 4).alias("coverage"))


def overview(log: DataFrame, profiles: Column, since: str) -> DataFrame:
    """Totals of a change log in one pass (G1-G4): rows, new and updated since a time, share of one method."""
    recent = F.col("changed_at") >= F.lit(since).cast("timestamp")
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(recent & (F.col("field") == "*")).alias("new_this_period"),
        F.count_distinct(F.when(recent & (F.col("field") != "*"), profiles)).alias("updated_this_period"),
        F.when(F.count("*") == 0, 0.0).otherwise(F.round(F.count_if(F.col("method") == "llm") / F.count("*"), 4)).alias("llm_ratio"),
    )


def count_by_type(df: DataFrame, column: str, types: list[str]) -> DataFrame:
    """Count of each listed type, types without rows included, and the total."""
    known = df.sparkSession.createDataFrame([(t,) for t in types], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("cnt"))
    each = known.join(counts, column, "left").select(column, F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return each.unionByName(each.agg(F.lit("total").alias(column), F.sum("cnt").alias("cnt")))


def task_stats(rows: DataFrame, batch: str, failed: Column, errors: DataFrame | None = None) -> DataFrame:
    """total, failed, and success = max(total - failed, 0) of each batch (G12), with errors where a table of them is given."""
    out = rows.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"))
    out = out.withColumn("success", F.greatest(F.col("total") - F.col("failed"), F.lit(0)))
    if errors is not None:
        out = out.join(errors.groupBy(batch).agg(F.count("*").alias("errors")), batch, "left").fillna(0, ["errors"])
    return out


def with_children(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with each child table as an array of structs, empty where there are none."""
    out = parents
    for name, child in children.items():
        fields = [c for c in child.columns if c != key]
        nested = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out
