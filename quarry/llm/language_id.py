"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of the lower-cased texts of labelled documents, in tasks, into one row for
each language and bucket; the table of log probabilities (languages x BUCKETS) is the only thing broadcast. Scoring
goes over whole texts in Arrow batches: the n-grams of a batch are one sparse list of buckets whose rows of the table
are summed for each document with numpy. The score is the posterior probability of the predicted language.

Bounds: the classifier is fitted on TRAIN_DOCS labelled documents at most, those with the smallest hash of doc_id
(whole texts); every language among them is learned.

Defined results: texts that are null or have no letter get `und` and score 0.0; where no document is labelled, all
documents get `und`; documents with a null doc_id are scored, are not held out and never train; repeated rows are
scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import doc_crc, small_batches, table

BUCKETS, GRAMS = 1 << 15, (1, 2, 3)
TRAIN_DOCS = 8_000
UNDETERMINED = "und"
#: Characters handled at once; n-grams do not cross the cut between two pieces of one text.
PIECE_CHARS = 1 << 18


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of a text, piece by piece; runs of other characters than letters count as one space."""
    lowered = text.lower()
    for a in range(0, len(lowered), PIECE_CHARS):
        points = np.frombuffer(lowered[a : a + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = (points >= 0x80) | ((points >= 97) & (points <= 122))
        points = np.where(letter, points, np.uint32(32))
        points = np.concatenate(([np.uint32(32)], points[letter | np.concatenate(([True], letter[:-1]))], [np.uint32(32)]))
        rolled = np.zeros(len(points), dtype=np.uint32)
        out = []
        for n in range(1, max(GRAMS) + 1):
            rolled = (rolled[: len(points) - n + 1] * np.uint32(0x01000193)) ^ points[n - 1 :]
            if n in GRAMS and len(rolled):
                h = rolled * np.uint32(0x9E3779B1) + np.uint32(n)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                out.append((h >> np.uint32(17)).astype(np.int32))
        yield np.concatenate(out)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for buckets in gram_buckets(text):
                own += np.bincount(buckets, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of priors and buckets: one row for each language) from docs (doc_id, text, lang)."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("lang", "text", "doc_id")
    sample = labelled.select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(limit).agg(F.max("h").alias("top"), F.count("*").alias("n")).first()
    if not sample["n"]:
        return [], np.zeros((0, BUCKETS + 1))
    sample = labelled.where(F.xxhash64("doc_id") <= sample["top"])
    priors = sample.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in priors)
    rows = sample.mapInArrow(_counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), BUCKETS), 0.5)
    np.add.at(counts, (np.searchsorted(languages, rows["lang"].to_numpy(str)), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    prior = {r["lang"]: r["count"] for r in priors}
    prior = np.array([prior[x] for x in languages], dtype=float)
    return languages, np.column_stack([np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True))])


def _scorer(languages: list[str], shared):
    def score(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        model = shared.value
        prior, weights = model[0], model[1:]
        preds, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not languages:
            return preds, scores
        parts: list[np.ndarray] = []
        owners: list[int] = []
        total = 0
        sums = np.zeros((len(texts), len(languages)))

        def flush() -> None:
            nonlocal parts, owners, total
            if parts:
                starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                np.add.at(sums, owners, np.add.reduceat(weights[np.concatenate(parts)], starts, axis=0))
            parts, owners, total = [], [], 0

        known = []
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                known.append(i)
                for buckets in gram_buckets(text):
                    parts.append(buckets)
                    owners.append(i)
                    total += len(buckets)
                    if total > 200_000:
                        flush()
        flush()
        if known:
            logs = sums[known] + prior
            best = logs.argmax(axis=1)
            top = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, s in zip(known, best, top, strict=True):
                preds[i], scores[i] = languages[b], s
        return preds, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = score(batch.column("text").to_pylist())
            names = [n for n in batch.schema.names if n not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(preds, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score added; columns of these names are replaced. Needs a column text."""
    small_batches(docs.sparkSession)
    languages, table_ = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table_.T))
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(_scorer(languages, shared), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(doc_crc(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(doc_crc(F.col("doc_id"), 4) != 2))
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
