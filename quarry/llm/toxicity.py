"""Toxicity by non-negative positive-unlabelled learning.

The positives are documents that a label confirms as toxic; everything else is unlabelled, whatever its label. A
logistic model over hashed words is trained with numpy on the class-prior-corrected risk
prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)), with gradient steps against the correction where it turns negative.
The class prior is the share of toxic labels. Features are the presence of words (runs of bytes other than ASCII white
space and punctuation, A-Z lower-cased) hashed into BUCKETS; the FEATURES buckets whose document frequencies differ
most between positives and unlabelled texts are used, the others weigh nothing. By how many standard errors they have to
differ is chosen among LEAST_ZS on the training rows alone: a quarter of them is set aside, and the bound wins whose
model has the smallest positive-unlabelled estimate of the error there.

Bounds: the model is fitted on POSITIVES positive and UNLABELLED unlabelled documents at most, those with the
smallest hash of doc_id (whole texts, one for each doc_id). To the driver come document frequencies by bucket, 2 x BUCKETS numbers,
and of each sampled document the buckets that are candidates, FEATURES at most for each bound. Scoring goes over every whole text.

Defined results: null and empty texts have no features and get the score of the bias alone; without positives or
unlabelled texts to learn from, all scores are the class prior (0.0 where no label is known); documents with a null
doc_id are scored, are not held out and never train; of several labels of a document, the highest counts; repeated
rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import discard, doc_crc, hash_words, materialize, small_batches, table, text_chunks

BUCKETS, FEATURES = 1 << 18, 400
#: Standard errors by which a bucket's document frequencies must differ to be a feature: the bounds to choose from.
LEAST_ZS = (1.0, 2.0, 3.0, 4.0)
POSITIVES, UNLABELLED = 3_000, 9_000
STEPS, RATE, DECAY = 300, 0.1, 1e-4
_PUNCTUATION = np.arange(256, dtype=np.uint8)
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _PUNCTUATION[_c] = 32


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def word_buckets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct buckets of its words."""
    for _, _, data, offsets in text_chunks(column):
        words, at, _ = hash_words(_PUNCTUATION[data], offsets)
        words = (words >> np.uint64(46)).astype(np.int32)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(words[a:b])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, bucket, n): the task's documents that have each bucket, and their number in bucket -1."""
    counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for batch in batches:
        for toxic, buckets in zip(batch.column("toxic").to_pylist(), word_buckets(batch.column("text")), strict=True):
            counts[toxic, buckets] += 1
            counts[toxic, BUCKETS] += 1
    toxic, at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(toxic.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[toxic, at])], ["toxic", "bucket", "n"])


def _featurize(chosen: np.ndarray):
    """(toxic, apart, buckets): of each document the buckets that are among chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.intersect1d(s, chosen, assume_unique=True).astype(np.int32) for s in word_buckets(batch.column("text"))]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("apart"), lists], ["toxic", "apart", "buckets"])

    return run


def _smallest(df: DataFrame, limit: int) -> DataFrame:
    """Of df (doc_id) the limit doc_ids with the smallest hashes, once each."""
    return df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def choose(df_p: np.ndarray, df_u: np.ndarray, n_p: int, n_u: int, least_z: float) -> np.ndarray:
    """The sorted buckets that are features, from their document frequencies in n_p positives and n_u unlabelled texts."""
    if not n_p or not n_u:
        return np.zeros(0, np.int32)
    p, u = (df_p + 1) / (n_p + 2), (df_u + 1) / (n_u + 2)
    score = np.abs(p - u) / np.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)
    chosen = np.argsort(-score, kind="stable")[:FEATURES]
    return np.sort(chosen[score[chosen] >= least_z]).astype(np.int32)


def dense(sets: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(chosen)), dtype=np.float32)
    for i, s in enumerate(sets):
        x[i] = np.isin(chosen, s, assume_unique=True)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Of a logistic model the risk of positives, the corrected risk of negatives (which may be under 0), and the step's gradient
    by weights and bias: of both risks where the second is not under 0, else against it."""
    sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
    # logistic losses: of a positive -log s, of a negative -log(1 - s)
    positive = prior * -np.log(np.maximum(sp, 1e-12)).mean()
    negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
    if negative >= 0:
        cp, cu = prior * (sp - 1) / len(sp) - prior * sp / len(sp), su / len(su)
    else:
        cp, cu = prior * sp / len(sp), -su / len(su)
    return positive, negative, np.append(xp.T @ cp + xu.T @ cu, cp.sum() + cu.sum())


def _constant(prior: float) -> Model:
    share = min(max(prior, 1e-9), 1 - 1e-9)
    return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(share / (1 - share))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray) -> Model:
    """Non-negative PU learning of a logistic model on the chosen buckets of sets of buckets."""
    if not positive or not unlabelled or not len(chosen):
        return _constant(prior)
    xp, xu = (dense(sets, chosen).astype(np.float64) for sets in (positive, unlabelled))
    w, b = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        grad = risk(w, b, xp, xu, prior)[2] + DECAY * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(chosen, w, float(b))


def estimated_error(model: Model, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> float:
    """The positive-unlabelled estimate of the error rate: missed positives, and flagged unlabelled texts beyond the positives among them."""
    flagged = [np.mean(dense(sets, model.buckets) @ model.weights + model.bias >= 0) for sets in (positive, unlabelled)]
    return prior * (1 - flagged[0]) + max(0.0, flagged[1] - prior * flagged[0])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = float(known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    toxic = _smallest(known.where("toxic = 1").join(texts.select("doc_id"), "doc_id", "left_semi"), POSITIVES).withColumn("toxic", F.lit(1))
    sampled = toxic.union(_smallest(texts, UNLABELLED).withColumn("toxic", F.lit(0)))
    # of several texts with one doc_id the smallest counts
    own = texts.join(F.broadcast(sampled), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    own = materialize(own.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0), "toxic-sample")
    counted = own.select("toxic", "text").mapInArrow(_frequencies, "toxic int, bucket int, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    counts[counted["toxic"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    n_u, n_p = counts[:, BUCKETS]
    features = [choose(counts[1, :BUCKETS], counts[0, :BUCKETS], n_p, n_u, z) for z in LEAST_ZS]
    rows = own.select("toxic", "apart", "text").mapInArrow(_featurize(np.unique(np.concatenate(features))), "toxic int, apart boolean, buckets array<int>").toPandas()
    discard(own)
    rows["buckets"] = [np.asarray(x, dtype=np.int32) for x in rows["buckets"]]
    parts = {(t, a): rows.loc[(rows["toxic"] == t) & (rows["apart"] == a), "buckets"].tolist() for t in (0, 1) for a in (False, True)}
    best = 0
    if all(parts.values()):
        # frequencies of the texts that are not set aside
        df = [np.bincount(np.concatenate(parts[t, False]), minlength=BUCKETS) for t in (0, 1)]
        trial = [fit(parts[1, False], parts[0, False], prior, choose(df[1], df[0], len(parts[1, False]), len(parts[0, False]), z)) for z in LEAST_ZS]
        best = int(np.argmin([round(estimated_error(m, parts[1, True], parts[0, True], prior), 4) for m in trial]))
    return fit(parts[1, False] + parts[1, True], parts[0, False] + parts[0, True], prior, features[best])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(len(batch), model.bias)
            if len(model.buckets):
                for i, s in enumerate(word_buckets(batch.column("text"))):
                    at = np.minimum(np.searchsorted(model.buckets, s), len(model.buckets) - 1)
                    z[i] += model.weights[at[model.buckets[at] == s]].sum()
            names = [n for n in batch.schema.names if n not in ("score", "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text and with a column score, which replaces one of that name."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score")
    schema = T.StructType([*kept.drop("text").schema.fields, T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(_scorer(model), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    crc = doc_crc(F.col("doc_id"), 5)
    model = train(docs.where(crc != 0), labels.where(crc != 0))
    scored = score(docs.select("doc_id", "text", F.coalesce(crc == 0, F.lit(False)).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
