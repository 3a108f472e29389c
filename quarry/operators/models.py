"""The seam for model calls (U3-U5, U8, E6, E7): any client that answers a list of prompts, its answers checked against a schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import scalars as S
from quarry.operators import search, text_index
from quarry.operators.text_index import TextIndex
from quarry.session import small

Client = Callable[[list[str]], list[str]]


def answer(df: DataFrame, prompt: Column, client: Client, schema: str, out: str = "answer", error: str | None = None) -> DataFrame:
    """df with the client's answer to each prompt as a struct of the given schema; null where it is not such JSON.

    The client is called in the tasks, a batch at a time; a batch that fails gives nulls. With a name for error, that column has what the
    client raised, `no answer in the form asked for` where the answer is no such JSON, and null where all is well: an outage can be told from empty answers."""
    asked = df.withColumn("_prompt", prompt)
    fields = T.StructType([*asked.drop("_prompt").schema.fields, T.StructField("_text", T.StringType()), T.StructField("_error", T.StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            failed = None
            try:
                texts = client(batch["_prompt"].tolist())
            except Exception as raised:  # a failed call is a null answer; the row stays
                texts, failed = [None] * len(batch), f"{type(raised).__name__}: {raised}"[:1000]
            yield batch.drop(columns="_prompt").assign(_text=texts, _error=failed)

    found = asked.mapInPandas(call, fields).withColumn(out, F.from_json(S.fenced_json(F.col("_text")), schema))
    if error:
        found = found.withColumn(error, F.coalesce("_error", F.when(F.col(out).isNull(), "no answer in the form asked for")))
    return found.drop("_text", "_error")


def accept_fills(df: DataFrame, confidence: str, auto: float = 0.80, review: float = 0.60) -> DataFrame:
    """Fills by confidence: accepted from review on, and marked where under auto."""
    c = F.col(confidence)
    return df.withColumn("accepted", c >= review).withColumn("needs_review", (c >= review) & (c < auto))


def retrieved_context(index: TextIndex, rows: DataFrame, key: str, text: Column, passages: DataFrame, passage_key: str, passage: str, k: int = 5, budget: int = 4000) -> DataFrame:
    """rows with context: the best k passages for each row's text, in order, up to a budget of characters (E6, K3, P14); null where nothing is found.

    All rows are searched in one job; index is of the same passages by their key."""
    asked = rows.select(F.col(key).alias("_key"), text.alias("_text"))
    hits = text_index.search(index, asked, "_key", "_text", k)
    of = passages.select(F.col(passage_key).alias("key"), F.col(passage).alias("_passage")).dropDuplicates(["key"])
    packed = search.context_pack(hits.join(of, "key"), "query", "rank", "_passage", budget)
    return rows.join(packed, F.col(key) == F.col("query"), "left").select(*rows.columns, "context")


def enrich(df: DataFrame, required: list[str], recommended: list[str], prompt: Column, client: Client, least: float = 0.6) -> DataFrame:
    """A round of enrichment (E6): rows less complete than least are asked about, answers that are accepted fill what is empty, and every row is scored again.

    The client answers with confidence and a map fields. Adds before and after (completeness), accepted and needs_review."""
    whole = lambda: S.completeness([S.has_value(F.col(c)) for c in required], [S.has_value(F.col(c)) for c in recommended])
    scored = df.withColumn("before", whole())
    asked = answer(scored.where(F.col("before") < least), prompt, client, "confidence double, fields map<string,string>")
    judged = accept_fills(asked.withColumn("_confidence", F.coalesce("answer.confidence", F.lit(0.0))), "_confidence")
    fill = lambda c: F.when(~S.has_value(F.col(c)) & F.col("accepted"), F.coalesce(F.col("answer.fields")[c], F.col(c))).otherwise(F.col(c))
    filled = judged.select(*[fill(c).alias(c) if c in (*required, *recommended) else F.col(c) for c in df.columns], "before", "accepted", "needs_review")
    rest = scored.where(F.col("before") >= least).select(*df.columns, "before", F.lit(False).alias("accepted"), F.lit(False).alias("needs_review"))
    return filled.unionByName(rest).withColumn("after", whole())


def map_predicates(triples: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) triples by predicate and end types (J11, W10); the unmapped are staged, not lost."""
    # of several relations of a predicate the first by name counts
    one = mapping.groupBy("predicate", "subj_type", "obj_type").agg(F.min("rel").alias("rel"))
    joined = triples.join(small(one), ["predicate", "subj_type", "obj_type"], "left")
    return joined.where("rel is not null"), staged(joined.where("rel is null").drop("rel"))


#: Widths of the staging table's columns.
STAGED = {"subject": 512, "subj_type": 16, "predicate": 64, "object": 512, "obj_type": 16}


def staged(triples: DataFrame) -> DataFrame:
    """Triples as the staging table takes them (W10): names cut to its widths, nulls empty, no confidence 0, not written yet."""
    cut = {c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, width) for c, width in STAGED.items() if c in triples.columns}
    sure = {"confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))} if "confidence" in triples.columns else {}
    return triples.withColumns({**cut, **sure, "written": F.lit(False)})
