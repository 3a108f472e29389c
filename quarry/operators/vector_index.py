"""An inverted-file index for nearest neighbours (K1, K2, K5, T8): centroids, residual codes, probing, exact re-ranking, a top-k join of a table of queries.

build() fits LISTS centroids by spherical k-means and, of what is left of the vectors less their centroid, codebooks of PARTS product codes, both on
the SAMPLE vectors with the smallest hashes. Then every vector goes into the list of its nearest centroid. Lists are folders of a table whose rows are
blocks of about BLOCK vectors with their keys, codes and unit vectors; a list that holds a third of all vectors is just many blocks.

search() notes how near the farthest centroid is that each query probes, and pairs blocks of queries with blocks of vectors: a pair is
a product of matrices in a task, which keeps the best num_candidates rows of each of its queries over all its blocks. Candidates by code are re-ranked by the cosine in double
precision. Folders of lists that no query probes are not read. With codes=False the blocks' own vectors are compared, which is exact when all lists are
probed. tune() takes the fewest lists that hold the neighbours of sample queries among all rows, and the fewest candidates among which codes find them,
as both grow with the rows.

Vectors that are null, empty, zero, of another length than most of the sample, or not finite in an entry are in no list, and as queries have no neighbours. Rows
with equal or null keys are rows of their own. Ties go by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import shared_path, small_batches

#: Vectors on which the index is fitted, rounds of k-means, lists at most, parts of a code and words of a part, vectors of a block.
SAMPLE, ROUNDS, MOST_LISTS, PARTS, CODE_WORDS, BLOCK = 20_000, 12, 4096, 16, 256, 1024
#: Candidates that are re-ranked at least; the recall by lists, and by lists and codes, that tune() aims at on so many sample queries.
CANDIDATES, RECALL, FOUND, TUNED_ON = 200, 0.985, 0.96, 300
#: Queries of a block, and rows that a task keeps for its queries.
ASKED, KEPT = 900, 400_000


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x @ words.T - (words * words).sum(axis=1) / 2).argmax(axis=1)


def kmeans(x: np.ndarray, k: int, seed: int, spherical: bool = False) -> np.ndarray:
    """k centroids of x; those that lose their vectors start again from the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    words = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, words)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            words[empty] = x[np.argsort(((x - words[own]) ** 2).sum(axis=1))[::-1][np.arange(len(empty)) % len(x)]]
        if spherical:
            words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-300)
    return words


def unit(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that count, those vectors as unit vectors)."""
    own = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and not any(c is None for c in v)]
    x = np.array([vectors[i] for i in own], dtype=np.float64).reshape(len(own), dim)
    scale = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(scale) & (scale > 0)
    x = x[good] / scale[good][:, None]
    return np.array(own, dtype=np.int64)[good], x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class VectorIndex:
    """Centroids (lists x dim), codebooks (words x dim of each part) and the table under path: list, keys, codes, vectors."""

    spark: SparkSession
    path: str
    key_type: str
    centroids: np.ndarray
    codebooks: list[np.ndarray]
    probes: int = 0
    candidates: int = CANDIDATES

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def blocks(self, lists: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"keys array<{self.key_type}>, codes binary, vectors binary, list int").parquet(self.path)
        return rows if lists is None else rows.where(F.col("list").isin(lists))


def build(rows: DataFrame, key: str, column: str, lists: int | None = None, path: str | None = None) -> VectorIndex:
    """Index rows (key, column of arrays); without a number of lists, the square root of the rows' number, at most MOST_LISTS and a tenth of the sample."""
    spark = rows.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "vector-index")
    kept = rows.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector"))
    sample = [r[0] for r in kept.where("vector is not null").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").collect()]
    lengths = pd.Series([len(v) for v in sample if len(v)]).mode()
    dim = int(lengths.max()) if len(lengths) else 1
    _, x = unit(sample, dim)
    n = kept.count()
    wanted = max(1, min(lists or math.isqrt(n), MOST_LISTS, max(1, len(x) // 10) if lists is None else len(x) or 1))
    centroids = kmeans(x, wanted, 1, spherical=True) if len(x) else np.zeros((1, dim))
    own = _nearest(x, centroids)
    rest = np.array_split(x - centroids[own] if len(x) else np.zeros((1, dim)), min(PARTS, dim), axis=1)
    codebooks = [kmeans(r, min(CODE_WORDS, len(r)), 2 + i) for i, r in enumerate(rest)]
    index = VectorIndex(spark, path, kept.schema["key"].dataType.simpleString(), centroids, codebooks)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, v = unit(batch["vector"].tolist(), dim)
            yield batch.iloc[places].assign(list=_nearest(v, centroids).astype("int32") if len(v) else np.zeros(0, "int32"))

    key_type = index.key_type
    listed = kept.mapInPandas(assign, f"key {key_type}, vector array<double>, list int")
    sizes = listed.groupBy("list").count().collect()  # one row a list
    count = F.create_map(*[F.lit(x) for r in sizes for x in (r["list"], max(1, r["count"] // BLOCK))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    # rows are dealt to blocks by number, so that equal keys and vectors do not meet in one
    dealt = listed.withColumn("block", F.pmod(F.monotonically_increasing_id(), count[F.col("list")].cast("long")))
    blocks = dealt.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct("key", "vector"))).alias("rows"))
    blocks = blocks.select("list", "block", F.col("rows.key").alias("keys"), F.col("rows.vector").alias("vectors"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, vectors = [], []
            for number, block in zip(batch.column("list").to_pylist(), batch.column("vectors"), strict=True):
                _, v = unit(block.as_py(), dim)
                codes.append(index_codes(v, number).tobytes())
                vectors.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("list"), batch.column("block"), batch.column("keys"), pa.array(codes, pa.binary()), pa.array(vectors, pa.binary())], ["list", "block", "keys", "codes", "vectors"])

    def index_codes(v: np.ndarray, number: int) -> np.ndarray:
        return np.column_stack([_nearest(r, b) for r, b in zip(np.array_split(v - centroids[number], len(codebooks), axis=1), codebooks, strict=True)]).astype(np.uint8)

    coded = blocks.mapInArrow(encode, f"list int, block long, keys array<{key_type}>, codes binary, vectors binary")
    coded.repartitionByRange("list", "block").drop("block").write.partitionBy("list").parquet(path)
    # copies of one vector would count many times
    different = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:TUNED_ON]]
    index.probes, index.candidates = tune(index, different.tolist(), n) if len(x) else (1, CANDIDATES)
    return index


def search(index: VectorIndex, queries: DataFrame, query: str, column: str, k: int = 20, num_candidates: int | None = None, probes: int | None = None, codes: bool = True) -> DataFrame:
    """The k nearest rows to each query of queries (query, column) by cosine: query, key, sim and rank.

    A query probes its nearest probes lists, and the best num_candidates by code are re-ranked by cosine (without a number, as many as tune() found)."""
    candidates = max(k, num_candidates or index.candidates)
    return _ranked(_probed(index, queries, query, column, min(probes or index.probes, len(index.centroids)), candidates, codes, k), k)


def nearest(index: VectorIndex, queries: DataFrame, query: str, column: str, k: int = 20) -> DataFrame:
    """The k nearest rows of all lists to each query, exactly; sim has 9 digits, so that ties do not hang on the order of a sum."""
    return _ranked(_probed(index, queries, query, column, len(index.centroids), k, False), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "key")
    return hits.withColumn("sim", F.round("sim", 9)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "key", "sim", "rank")


def _probed(index: VectorIndex, queries: DataFrame, query: str, column: str, probes: int, candidates: int, codes: bool, k: int | None = None, places: bool = False) -> DataFrame:
    """The best candidates rows to each query of every part of the table: query, key, sim and list; with places also n, the place by code.

    A task takes some blocks of queries through a part of the table's blocks and keeps the best rows as it goes, so that its memory and what it hands on
    hang on its queries, not on the number of lists or rows. Where it takes them through the whole table, its candidates are final, and only those that can be
    among the best k by cosine are handed on."""
    small_batches(index.spark)
    spark, dim, centroids, codebooks, key_type = index.spark, index.dim, index.centroids, index.codebooks, index.key_type
    every = probes >= len(centroids)
    asked = queries.select(F.col(query).alias("query"), F.col(column).cast("array<double>").alias("vector"))
    query_type = asked.schema["query"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query the similarity of the farthest centroid that it probes: a number instead of a row a list
        for batch in batches:
            places, v = unit(batch.column("vector").to_pylist(), dim)
            if not len(v):
                continue
            near = v @ centroids.T
            least = np.full(len(v), -np.inf) if every else -np.partition(-near, probes - 1, axis=1)[:, probes - 1] - 1e-12
            lists = [] if every else np.flatnonzero((near >= least[:, None]).any(axis=0)).tolist()
            ids = batch.column("query").take(pa.array(places))
            columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v.tobytes()], pa.binary()), pa.array([least.tobytes()], pa.binary()), pa.array([lists], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["queries", "asked", "least", "lists"])

    path = shared_path(spark, "probes")
    block = max(1, min(ASKED, KEPT // candidates))
    even = asked.repartition(max(1, math.ceil(asked.count() / block)))
    even.mapInArrow(probe, f"queries array<{query_type}>, asked binary, least binary, lists array<int>").withColumn("part", F.monotonically_increasing_id()).write.parquet(path)
    grouped = spark.read.parquet(path)
    lists = None if every else [r[0] for r in grouped.select(F.explode("lists")).distinct().collect()]  # at most MOST_LISTS numbers: the folders to read
    shares = max(1, math.ceil(grouped.count() / max(1, KEPT // (block * candidates))))
    parts = math.ceil(2 * spark.sparkContext.defaultParallelism / shares)
    least_sims = k if codes and parts == 1 and not places else None
    own = grouped.drop("lists").repartitionByRange(shares, "part")
    pairs = index.blocks(lists).coalesce(parts).crossJoin(own.hint("shuffle_replicate_nl"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in range(len(batch)):
                number, part = batch.column("list")[row].as_py(), batch.column("part")[row].as_py()
                q = np.frombuffer(batch.column("asked")[row].as_buffer()).reshape(-1, dim)
                wanted = np.flatnonzero(q @ centroids[number] >= np.frombuffer(batch.column("least")[row].as_buffer()) - 1e-12)
                if part not in best:
                    best[part] = _Best(pa.concat_arrays([batch.column("queries")[row].values]), candidates)
                v = np.frombuffer(batch.column("vectors")[row].as_buffer()).reshape(-1, dim)
                if not len(wanted) or not len(v):
                    continue
                q = q[wanted]
                about = sims = q @ v.T
                if codes:
                    coded = np.frombuffer(batch.column("codes")[row].as_buffer(), np.uint8).reshape(-1, len(codebooks))
                    pieces = np.array_split(q, len(codebooks), axis=1)
                    about = (q @ centroids[number])[:, None] + sum((p @ b.T)[:, coded[:, j]] for j, (p, b) in enumerate(zip(pieces, codebooks, strict=True)))
                best[part].add(wanted, about, sims, batch.column("keys")[row].values, number)
        for kept in best.values():
            yield from kept.rows(least_sims)

    found = pairs.mapInArrow(score, f"query {query_type}, key {key_type}, about double, sim double, list int")
    if not codes or least_sims:
        return found.drop("about")
    first = Window.partitionBy("query").orderBy(F.desc("about"), "key")
    return found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= candidates).drop("about", *([] if places else ["n"]))


class _Best:
    """The best rows so far to each query of a block, ties by key."""

    def __init__(self, queries: pa.Array, most: int):
        self.queries, self.most, self.waiting = queries, most, 0
        self.least = np.full(len(queries), -np.inf)
        self.parts: list[pa.Table] = []

    def add(self, places: np.ndarray, about: np.ndarray, sims: np.ndarray, keys: pa.Array, number: int) -> None:
        """Rows of a block in the order of their keys, with their values to the queries at places."""
        good = about >= self.least[places][:, None] - 1e-9
        many = np.flatnonzero(good.sum(axis=1) > self.most)
        if len(many):
            # keys of a block are in order, so of equal rows those with the smallest keys stay
            first = np.argsort(-np.round(about[many], 9), axis=1, kind="stable")[:, : self.most]
            good[many] = False
            good[many[:, None], first] = True
        at, col = np.nonzero(good)
        if not len(at):
            return
        columns = [pa.array(places[at].astype(np.int32)), keys.take(pa.array(col)), pa.array(np.round(about[at, col], 9)), pa.array(sims[at, col]), pa.array(np.full(len(at), number, np.int32))]
        self.parts.append(pa.table(columns, ["place", "key", "about", "sim", "list"]))
        self.waiting += len(at)
        if self.waiting > self.most * len(self.queries):
            self.settle()

    def settle(self) -> None:
        rows = pa.concat_tables(self.parts)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("place", "ascending"), ("about", "descending"), ("key", "ascending")], null_placement="at_start"))
        place = rows.column("place").to_numpy()
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        last = rank == self.most - 1
        self.least[place[last]] = rows.column("about").to_numpy()[last]
        self.parts, self.waiting = [rows.filter(pa.array(rank < self.most)).combine_chunks()], 0

    def rows(self, k: int | None = None) -> Iterator[pa.RecordBatch]:
        """The rows kept; with k those that are as near by cosine, but for its last digits, as the k-th of their query."""
        if self.parts:
            self.settle()
            rows = self.parts[0]
            if k:
                place, sims = rows.column("place").to_numpy(), rows.column("sim").to_numpy()
                order = np.lexsort((-sims, place))
                rank = np.arange(len(order)) - np.searchsorted(place, place)
                bound = np.full(len(self.queries), -np.inf)
                bound[place[order][rank == k - 1]] = sims[order][rank == k - 1]
                rows = rows.filter(pa.array(sims >= bound[place] - 1e-8)).combine_chunks()
            for part in rows.to_batches(max_chunksize=20_000):
                yield pa.RecordBatch.from_arrays([self.queries.take(part.column("place")), *part.columns[1:]], ["query", "key", "about", "sim", "list"])


def recall(index: VectorIndex, queries: DataFrame, query: str, column: str, k: int = 20, **options) -> float:
    """The share of the k nearest rows by an exact search of all lists that a search with these options finds."""
    exact = nearest(index, queries, query, column, k)
    found = search(index, queries, query, column, k, **options)
    both = exact.join(found.select("query", "key").distinct(), ["query", "key"], "left_semi").count()
    return both / max(1, exact.count())


def tune(index: VectorIndex, vectors: list[list[float]], n: int, k: int = 20) -> tuple[int, int]:
    """(lists, candidates) for an index of n rows, from the k nearest of all rows to each of these vectors.

    Lists are taken by their centroids' nearness, the fewest in which RECALL of the nearest lie; then the fewest candidates, at least CANDIDATES,
    among which FOUND of the nearest are."""
    queries = index.spark.createDataFrame(list(enumerate(vectors)), "query int, vector array<double>")
    hits = _probed(index, queries, "query", "vector", len(index.centroids), k, False)
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "key")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "key", "list").collect()  # k for each of a few vectors
    if not hits:
        return 1, CANDIDATES
    places, v = unit(vectors, index.dim)
    place = np.argsort(np.argsort(-(v @ index.centroids.T), axis=1), axis=1)[np.searchsorted(places, [r["query"] for r in hits]), [r["list"] for r in hits]]
    probes = int(np.sort(place)[math.ceil(RECALL * len(hits)) - 1]) + 1
    # rows without a key or with another's are left out, as they cannot be told apart
    pairs = [(r["query"], r["key"]) for r in hits if r["key"] is not None]
    near = index.spark.createDataFrame(sorted(set(pairs)), f"query int, key {index.key_type}")
    tried = 4 * CANDIDATES
    while pairs:
        coded = _probed(index, queries, "query", "vector", probes, tried, True, places=True)
        at = sorted(r["n"] for r in coded.join(F.broadcast(near), ["query", "key"]).groupBy("query", "key").agg(F.min("n").alias("n")).collect())
        wanted = math.ceil(FOUND * len(set(pairs)))
        if len(at) >= wanted or tried >= n:
            return probes, max(CANDIDATES, at[wanted - 1] if len(at) >= wanted else tried)
        tried *= 4
    return probes, CANDIDATES
