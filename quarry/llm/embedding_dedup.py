"""Embedding near-dedup with spherical-cap filters from structured random product codes.

Vectors are rotated at random and cut into two halves; a filter direction is a pair of random code words, one for each
half, so that CODE x CODE directions need only 2 x CODE words. List decoding sorts a vector's inner products with the
words of each half and finds the PASSES pairs with the greatest sums: the cap of a vector's own that holds so many filters,
so every vector is filed under the same number, whatever the code's size. There are CODES codes, each with its own
rotation and words. Vectors that share a filter are compared by cosine in double precision, and links are pairs that
reach the threshold; a pair that shares several filters counts at the first.

The number of filters follows the number of vectors, so lists keep their length. A list that is long all the same, as
where a third of the vectors are alike, is cut into blocks that are compared two at a time; out of a task come counts
for each vector and a forest of its links, never all pairs. Equal vectors are one node with a weight.

Filters grow finer with the number of vectors, and a pair at the threshold then shares fewer: the recall of pairs at the very
threshold is measured on random ones for each length of vector, and the code is made coarser, with longer lists, until
it is LEAST_RECALL (code_size). Tests hold it over 0.95 at all sizes of the code; closer pairs are found more surely.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length link with nothing; repeated rows and equal vectors link with each other; component_id is the
smallest vec_id of a component, null only where all are null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, discard, materialize, small_batches, table

#: Independent codes, filters of each that a vector is filed under, and words of a half.
CODES, PASSES, LEAST_CODE, MOST_CODE = 2, 20, 64, 4096
#: Dimensions under which vectors are filled up with zeros before the rotation, and vectors decoded at once.
LEAST_DIM, DECODED = 8, 256
#: Least share of random pairs at the threshold that have to share a filter, and pairs on which it is measured.
LEAST_RECALL, MEASURED = 0.98, 1000
#: Vectors of a list in one block, and lists that one task call takes together.
BLOCK, LISTS = 512, 32


@lru_cache(maxsize=2 * CODES)
def _code(dim: int, size: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and the words of both halves of one code, the same in every task."""
    rng = np.random.default_rng([dim, size, number])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    words = [rng.standard_normal((size, d)) for d in (dim // 2, dim - dim // 2)]
    return rotation, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]


def _greatest(products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row, falling, and their columns."""
    columns = np.argpartition(-products, k - 1, axis=1)[:, :k]
    values = np.take_along_axis(products, columns, 1)
    order = np.argsort(-values, axis=1)
    return np.take_along_axis(values, order, 1), np.take_along_axis(columns, order, 1)


def list_decode(vectors: np.ndarray, size: int, passes: int = PASSES) -> np.ndarray:
    """For each unit vector the sorted numbers of the filters nearest to it, passes of each code."""
    vectors = np.pad(vectors, ((0, 0), (0, max(0, LEAST_DIM - vectors.shape[1]))))
    dim = vectors.shape[1]
    # the i-th and the j-th word of the halves are among the best pairs only if i * j pairs are no more than passes
    ranks = np.arange(1, passes + 1)
    i, j = np.nonzero(np.outer(ranks, ranks) <= passes)
    out = np.empty((len(vectors), CODES * passes), dtype=np.int32)
    for number in range(CODES):
        rotation, (left, right) = _code(dim, size, number)
        for at in range(0, len(vectors), DECODED):
            turned = vectors[at : at + DECODED] @ rotation
            a, rows = _greatest(turned[:, : dim // 2] @ left.T, passes)
            b, columns = _greatest(turned[:, dim // 2 :] @ right.T, passes)
            best = np.argpartition(-(a[:, i] + b[:, j]), passes - 1, axis=1)[:, :passes]
            pairs = np.take_along_axis(rows[:, i], best, 1) * size + np.take_along_axis(columns[:, j], best, 1)
            out[at : at + DECODED, number * passes : (number + 1) * passes] = np.sort(pairs + number * size**2, axis=1)
    return out


def pair_recall(dim: int, size: int, cosine: float, pairs: int = MEASURED, seed: int = 0) -> float:
    """The share of random pairs of this very cosine that share a filter."""
    rng = np.random.default_rng([dim, size, seed])
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, pairs, dim)))
    if dim > 1:
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    else:
        y = x
    both = np.sort(np.hstack([list_decode(x, size), list_decode(y, size)]), axis=1)
    return float((both[:, 1:] == both[:, :-1]).any(axis=1).mean())


def code_size(dim: int, n: int, cosine: float) -> int:
    """Words of a half for n vectors: about n filters, or as many as leave pairs at the threshold their recall."""
    size = min(MOST_CODE, max(LEAST_CODE, math.isqrt(n // CODES) + 1))
    while size > LEAST_CODE and pair_recall(dim, size, cosine) < LEAST_RECALL:
        size = max(LEAST_CODE, size * 3 // 4)
    return size


def _file(code_sizes: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("node").to_pylist(), batch.column("vector").to_pylist()
            sizes = [len(v) for v in vectors]
            rows, lists = [], []
            for dim in sorted(set(sizes)):
                own = [i for i, s in enumerate(sizes) if s == dim]
                x = np.array([vectors[i] for i in own], dtype=np.float64)
                # scaled before the norm, which would not be finite for the largest components
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                rows += own
                lists += list(list_decode(x, code_sizes[dim]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["node", "filters"])

    return run


def _compare(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("filter", "ascending"), ("dim", "ascending"), ("node", "ascending")])
        filters, dims, nodes, weights, blocks = (rows.column(c).to_numpy() for c in ("filter", "dim", "node", "weight", "block"))
        vectors, passed = rows.column("vector").to_numpy(), rows.column("filters").to_numpy()
        first, second = rows.column("first")[0].as_py(), rows.column("second")[0].as_py()
        links: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        cuts = np.flatnonzero((np.diff(filters, prepend=-1) != 0) | (np.diff(dims, prepend=-1) != 0))
        for a, b in zip(cuts, [*cuts[1:], len(nodes)], strict=True):
            if b - a < 2:
                continue
            x = np.stack(vectors[a:b]).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = np.triu(x @ x.T >= cosine, 1)
            if first != second:
                near &= blocks[a:b, None] != blocks[None, a:b]
            if not near.any():
                continue
            # a pair belongs to the first filter that it shares
            used = near.any(axis=0) | near.any(axis=1)
            own = np.flatnonzero(used)
            earlier = [p[p < filters[a]] for p in passed[a:b][own]]
            names, where = np.unique(np.concatenate(earlier), return_inverse=True)
            holder = np.repeat(np.arange(len(own)), [len(e) for e in earlier])
            twice = np.bincount(where, minlength=len(names)) > 1
            column = np.cumsum(twice) - 1
            member = np.zeros((len(own), int(twice.sum())), dtype=np.float32)
            member[holder[twice[where]], column[where[twice[where]]]] = 1
            new = near[np.ix_(own, own)] & (member @ member.T == 0)
            for i, j in zip(*np.nonzero(new), strict=True):
                p, q = a + own[i], a + own[j]
                s, t = int(nodes[p]), int(nodes[q])
                links[s] = links.get(s, 0) + int(weights[q])
                links[t] = links.get(t, 0) + int(weights[p])
                s, t = find(s), find(t)
                if s != t:
                    root[max(s, t)] = min(s, t)
        out = sorted(links)
        return pa.table({"src": pa.array(out, pa.int64()), "dst": pa.array([find(x) for x in out], pa.int64()), "links": pa.array([links[x] for x in out], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id of each row of vectors (vec_id, embedding)."""
    small_batches(vectors.sparkSession)
    raw = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", F.col("embedding"), raw.alias("vector"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    grouped = rows.where(F.coalesce(usable, F.lit(False))).groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "vec-nodes")
    counts = nodes.groupBy(F.size("vector").alias("dim")).count().collect()
    code_sizes = {r["dim"]: code_size(r["dim"], r["count"], cosine) for r in counts}
    filed = nodes.select("node", "vector").mapInArrow(_file(code_sizes), "node long, filters array<int>")
    filed = materialize(filed, "vec-filters")
    entries = filed.select("node", F.explode("filters").alias("filter"))
    lists = entries.groupBy("filter").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = entries.join(lists, "filter").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.floor(F.col("filter") / LISTS)).otherwise(-1 - F.col("filter").cast("long"))
    placed = placed.select("node", "filter", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), cell.alias("cell"))
    full = placed.join(nodes.select("node", "weight", "vector", F.size("vector").alias("dim")), "node").join(filed, "node")
    found = materialize(full.groupBy("cell", "first", "second").applyInArrow(_compare(cosine), "src long, dst long, links long"), "vec-links")
    components = connected_components(found.select("src", "dst"), "vec")
    linked = found.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.join(linked, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    discard(filed)
    out = rows.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    alone = F.col("n_links").isNull()
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs by cosine, and their closure.
ORACLE = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9
), reach AS (SELECT vec_id AS r, vec_id FROM embeddings UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.vec_id
), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = vec_id
"""
