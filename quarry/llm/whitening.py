"""Whitening of embeddings by LOBPCG over distributed products of the covariance with blocks of directions.

Each entry c becomes the whole number floor(64 * c) + 1000000. One pass sums them exactly. Every round of LOBPCG makes an orthonormal
basis of the iterate, the residual and the previous direction, multiplies the covariance with that basis in one pass over
the centred rows (a task keeps one block of products, whatever the number of rows), and solves the small problem on the
driver (Rayleigh-Ritz). Products are taken anew from the rows each time, never carried on by linear combination, so the residuals
that end the iteration are those of the covariance itself. A last pass takes the covariance of the whitened rows.

The driver and each task hold matrices of the vectors' length by 3 * (components + GUARD) numbers and nothing that grows with the
rows. Blocks of products are summed by dimension, in Spark. The rows are read once a round and never copied.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, as are those with an entry whose
whole number has more than 62 bits; so are vectors of another length than most have (of equally frequent lengths the longest), which
have no covariance with the rest. Equal rows are rows of their own; null vec_ids are carried. deviation is null where it has more than
63 bits. A component without variance has whitened null, and explained is 0 where no component has any. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Directions beyond the wanted ones, which make the last of these converge sooner.
GUARD = 8
#: Greatest residual of a wanted component, as a share of the greatest eigenvalue; rounds after which an uncertified result is an error.
RESIDUAL, MOST_ROUNDS = 1e-13, 1000
#: Share of the greatest eigenvalue from which on a direction has variance, and of its length from which on one is independent.
LEAST_VARIANCE, INDEPENDENT = 1e-12, 1e-10
#: Rows multiplied at once, and numbers in one row of a block of products.
ROWS, WIDTH = 4096, 16
#: Magnitude of whole numbers that fit.
MOST = float(1 << 62)


def whole_numbers(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that count, their whole numbers less OFFSET)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    own = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(own)).flatten().cast(pa.float64())
    values = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(own), length) * SCALE)
    good = (np.abs(values) < MOST).all(axis=1)  # false for what is no number
    return own[good], values[good].astype(np.int64)


def vector_length(rows: DataFrame, column: str = "embedding") -> int:
    """The commonest length of vectors that count, the longest of equally common ones; 0 without any."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST / SCALE))
    counts = rows.where(v.isNotNull() & (F.size(v) > 0) & finite).groupBy(F.size(v).alias("length")).count()
    first = counts.orderBy(F.desc("count"), F.desc("length")).first()
    return first["length"] if first else 0


def sums(rows: DataFrame, length: int, column: str = "embedding") -> tuple[int, list[int]]:
    """The number of rows, and of each dimension the exact sum of whole numbers less OFFSET."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for batch in batches:
            _, x = whole_numbers(batch.column(0), length)
            # in two halves, whose sums fit for any number of rows of a task
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(np.full(length, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = rows.select(column).mapInArrow(run, "dim int, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = {r["dim"]: r for r in parts.groupBy("dim").agg(F.sum("n").alias("n"), total("high"), total("low")).collect()}
    return found[0]["n"] if found else 0, [(int(found[d]["high"]) << 32) + int(found[d]["low"]) for d in range(length)] if found else []


def block_sums(rows: DataFrame, length: int, mean: np.ndarray, shape: tuple[int, int], kernel: Callable[[np.ndarray], np.ndarray], column: str = "embedding") -> np.ndarray:
    """The sum over all centred rows of kernel(block of rows), a matrix of the given shape."""
    height, width = shape
    parts = -(-width // WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, parts * WIDTH))
        for batch in batches:
            _, x = whole_numbers(batch.column(0), length)
            for at in range(0, len(x), ROWS):
                total[:, :width] += kernel(x[at : at + ROWS] - mean)
        cells = total.reshape(height * parts, WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height * parts, dtype=np.int32)), *(pa.array(cells[:, i].copy()) for i in range(WIDTH))], ["cell", *(f"v{i}" for i in range(WIDTH))])

    done = rows.select(column).mapInArrow(run, "cell int, " + ", ".join(f"v{i} double" for i in range(WIDTH)))
    found = done.groupBy("cell").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH))).toArrow()
    out = np.zeros((height * parts, WIDTH))
    out[found.column("cell").to_numpy()] = np.column_stack([found.column(f"v{i}").to_numpy() for i in range(WIDTH)])
    return out.reshape(height, parts * WIDTH)[:, :width]


def extended(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The orthonormal basis with the directions of more that are independent of it."""
    out = basis
    for v in more.T:
        size = np.linalg.norm(v)
        if not size or out.shape[1] == out.shape[0]:
            continue
        v = v / size
        left = v - out @ (out.T @ v)
        left -= out @ (out.T @ left)
        if np.linalg.norm(left) > INDEPENDENT:
            left /= np.linalg.norm(left)
            left -= out @ (out.T @ left)
            out = np.column_stack((out, left / np.linalg.norm(left)))
    return out


def lobpcg(product: Callable[[np.ndarray], np.ndarray], length: int, wanted: int, guard: int = GUARD, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors in columns, greatest residual as a share of the greatest eigenvalue) of a symmetric matrix
    that is known by its products with orthonormal blocks."""
    size = min(length, wanted + guard)
    x = np.linalg.qr(np.random.default_rng([length, seed]).standard_normal((length, size)))[0]
    basis, previous = x, np.zeros((length, 0))
    for _ in range(MOST_ROUNDS):
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1][:, :size]
        values = values[::-1][:size]
        before, x = x, basis @ turn
        residual = image @ turn - x * values
        sizes = np.linalg.norm(residual, axis=0)
        greatest = max(float(values[0]), 0.0)
        if sizes[:wanted].max() <= RESIDUAL * greatest or not greatest:
            x = x[:, :wanted] / np.linalg.norm(x[:, :wanted], axis=0)
            return np.maximum(values[:wanted], 0.0), x, float(sizes[:wanted].max() / greatest) if greatest else 0.0
        previous = x - before @ (before.T @ x)
        open_ = sizes > RESIDUAL * greatest / 10
        x = np.linalg.qr(x)[0] * np.sign(np.diag(np.linalg.qr(x)[1]))
        basis = extended(extended(x, residual[:, open_]), previous[:, open_])
    raise ArithmeticError(f"residuals of {sizes[:wanted].max() / greatest:.3g} of the greatest eigenvalue after {MOST_ROUNDS} rounds")


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """For each row the exact sum over dimensions of (n * x - S)^2, both less their offsets; None beyond 63 bits."""
    if not len(x):
        return []
    bound = n * int(np.abs(x).max()) + max(abs(s) for s in total)
    if bound * bound * len(total) < 1 << 63:
        return ((n * x - np.array(total, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row of rows (vec_id, embedding) and each component."""
    small_batches(rows.sparkSession)
    rows = rows.select(key, column)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = vector_length(rows, column)
    if not length:
        return rows.sparkSession.createDataFrame([], schema)
    n, total = sums(rows, length, column)
    mean = np.array([s / n for s in total])
    trace = float(block_sums(rows, length, mean, (1, length), lambda c: (c * c).sum(axis=0, keepdims=True), column).sum()) / n
    wanted = min(length, components)
    values, vectors, _ = lobpcg(lambda w: block_sums(rows, length, mean, w.shape, lambda c: c.T @ (c @ w), column) / n, length, wanted)
    some = values > LEAST_VARIANCE * max(values[0], 0.0)
    scaled = vectors[:, some] / np.sqrt(values[some])
    k = int(some.sum())
    error = 0.0
    if k:
        # the covariance of the whitened rows, with their mean in the last row
        seen = block_sums(rows, length, mean, (k + 1, k), lambda c: np.vstack(((z := c @ scaled).T @ z, z.sum(axis=0))), column) / n
        error = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    explained = values / trace if trace else np.zeros(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = whole_numbers(batch.column(1), length)
            for at in range(0, len(own), ROWS):
                part, here = x[at : at + ROWS], own[at : at + ROWS]
                white = np.full((len(here), wanted), np.nan)
                white[:, some] = (part - mean) @ scaled
                ids = batch.column(0).take(pa.array(np.repeat(here, wanted)))
                deviation = pa.array(deviations(part, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(len(here)), wanted)))
                flat = white.ravel()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(here))), pa.array(np.full(len(flat), n)), deviation, pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(here))), pa.array(np.full(len(flat), error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
