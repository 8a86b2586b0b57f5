"""Whitening of embeddings by the leading principal components of their covariance.

1. Entries become whole numbers, x = floor(64 c) + 1000000 (`quantised`). The fit list is each distinct
   x vector once, so that copies don't pull the components; its sums are exact.
2. Each task centres its vectors and multiplies them; the d (d + 1) / 2 sums of all tasks are the covariance,
   which alone reaches the driver (d: entries of a vector, whatever the number of rows).
3. Householder reflections make it tridiagonal, bisection with Sturm counts finds the leading
   eigenvalues, inverse iteration their vectors; within a cluster of close eigenvalues each vector is
   made orthogonal to those before it. The reflections take the vectors back.
4. The components are broadcast (at most `components` x d numbers) and every row is projected on them.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out, and
so are rows whose vector has another length than most distinct vectors (of equally frequent lengths: the
longest). Components whose eigenvalue is zero to working precision (no spread in that direction) are left
out, so that a table of one distinct vector gives no rows. Repeated rows and null ids are kept. A
`deviation` beyond 64 bits is null; entries whose x goes beyond 64 bits raise Spark's overflow error.
Only the columns named are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.batches import bounded
from floeline.sources import scratch

# fixed values of the quantisation
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues nearer than this share of the matrix norm belong to one cluster.
CLUSTER = 1e-3
_EPS = np.finfo(np.float64).eps
_LIMIT = 2**63 - 1


def quantised(rows: DataFrame, vector: str = "embedding", name: str = "x") -> DataFrame:
    """The rows whose vector is whole, with its whole numbers as `name` in place of the vector."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = (F.size(vector) > 0) & ~F.exists(vector, lambda c: entry(c.cast("double")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT))
    return rows.where(whole).withColumn(vector, x).withColumnRenamed(vector, name)


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a batch, all of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, and per dimension the sum in two halves (neither can overflow), the least and the largest entry."""
    count, parts = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        found = np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)])
        count += len(x)
        if parts is None:
            parts = found
        else:
            parts = np.stack([parts[0] + found[0], parts[1] + found[1], np.minimum(parts[2], found[2]), np.maximum(parts[3], found[3])])
    if parts is not None:
        d = parts.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d)), pa.array(np.full(d, count)), *map(pa.array, parts)],
            names=["i", "n", "high", "low", "least", "most"],
        )


@dataclass(frozen=True)
class Centre:
    """n vectors, their exact sums, and the sums as whole and broken part of the mean."""

    n: int
    sums: tuple[int, ...]
    widest: int  # the largest |n x - S|

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def broken(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part goes first, so that large entries lose no digits."""
        return (x - self.whole).astype(np.float64) - self.broken

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; null beyond 64 bits."""
        left = np.array([s % self.n for s in self.sums], dtype=np.int64)
        if self.widest * self.widest * len(self.sums) <= _LIMIT:
            return (((x - self.whole) * self.n - left) ** 2).sum(axis=1).tolist()
        exact = (((x - self.whole).astype(object) * self.n - left.astype(object)) ** 2).sum(axis=1)
        return [v if v <= _LIMIT else None for v in exact.tolist()]


def centre(fit: DataFrame) -> Centre | None:
    """Exact sums of the fit list (one column of lists); d rows reach the driver."""
    found = fit.mapInArrow(_sums, "i long, n long, high long, low long, least long, most long").groupBy("i").agg(
        F.sum("n"), F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)")), F.min("least"), F.max("most")
    )
    rows = sorted(tuple(r) for r in found.collect())
    if not rows:
        return None
    n = rows[0][1]
    sums = tuple(int(high) * 2**32 + int(low) for _, _, high, low, _, _ in rows)
    widest = max(max(abs(n * least - s), abs(n * most - s)) for s, (*_, least, most) in zip(sums, rows, strict=True))
    return Centre(n, sums, widest)


def _products(seen):
    """Sums of products of what `seen` makes of the vectors of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = seen(_matrix(batch.column(0)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def _covariance(fit: DataFrame, seen, n: int) -> np.ndarray:
    """Covariance of centred values with divisor n; summed by Spark, its d (d + 1) / 2 numbers reach the driver."""
    rows = fit.mapInArrow(_products(seen), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    matrix = np.zeros((i.max() + 1, i.max() + 1))
    matrix[i, j] = matrix[j, i] = rows["v"].to_numpy() / n
    return matrix


def covariance(fit: DataFrame, middle: Centre) -> np.ndarray:
    return _covariance(fit, middle.centred, middle.n)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors (the k-th acts on entries k + 1 and on)."""
    a = matrix.astype(np.float64).copy()
    d = len(a)
    reflectors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.abs(v[1:]).max(initial=0.0)
        if not size:  # nothing to clear below the off-diagonal
            reflectors.append(np.zeros_like(v))
            continue
        size = max(size, abs(v[0]))
        v /= size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of `at`: the negative pivots of T - at."""
    tiny = _EPS * _norm(diagonal, off) + np.finfo(np.float64).tiny
    count = np.zeros(len(at), dtype=np.int64)
    pivot = np.ones(len(at))
    squares = np.concatenate([[0.0], off**2])
    for value, square in zip(diagonal, squares, strict=True):
        pivot = value - at - square / pivot
        pivot = np.where(np.abs(pivot) < tiny * _EPS, -tiny * _EPS, pivot)
        count += pivot < 0
    return count


def _norm(diagonal: np.ndarray, off: np.ndarray) -> float:
    beside = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    return float((np.abs(diagonal) + beside).max())


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, largest first, each bisected until no double lies between its bounds."""
    beside = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    spare = 2 * _EPS * _norm(diagonal, off)
    low = np.full(k, (diagonal - beside).min() - spare)
    high = np.full(k, (diagonal + beside).max() + spare)
    wanted = len(diagonal) - np.arange(1, k + 1)  # as many eigenvalues lie below it
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        under = sturm(diagonal, off, middle) <= wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, at: float, right: np.ndarray) -> np.ndarray:
    """z with (T - at) z = right, by elimination with row exchanges; zero pivots are replaced by tiny ones."""
    d = len(diagonal)
    main, upper, second = diagonal - at, np.append(off, 0.0), np.zeros(d)
    z = right.copy()
    tiny = _EPS * max(_norm(diagonal, off), np.finfo(np.float64).tiny / _EPS)
    for i in range(d - 1):
        under = off[i]
        if abs(under) > abs(main[i]):
            factor = main[i] / under
            main[i], upper[i], kept, second[i] = under, main[i + 1], upper[i], upper[i + 1]
            main[i + 1], upper[i + 1] = kept - factor * upper[i], -factor * second[i]
            z[i], z[i + 1] = z[i + 1], z[i] - factor * z[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            factor = under / main[i]
            main[i + 1] -= factor * upper[i]
            z[i + 1] -= factor * z[i]
    main[-1] = main[-1] if abs(main[-1]) > tiny else tiny
    for i in range(d - 1, -1, -1):
        after = (upper[i] * z[i + 1] if i + 1 < d else 0.0) + (second[i] * z[i + 2] if i + 2 < d else 0.0)
        z[i] = (z[i] - after) / main[i]
        if abs(z[i]) > 1e150:
            z /= abs(z[i])
    return z / np.linalg.norm(z)


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of T as columns, by inverse iteration."""
    norm, pick = _norm(diagonal, off), np.random.default_rng(1)
    found = np.empty((len(diagonal), len(values)))
    first, before = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # equal eigenvalues would give one and the same solution
        at = before = min(value, before - 4 * _EPS * norm) if k > first else value
        z = pick.uniform(-1, 1, len(diagonal))
        for _ in range(5):
            z = _solved(diagonal, off, at, z / np.linalg.norm(z))
            for _ in range(2):
                z = z - found[:, first:k] @ (found[:, first:k].T @ z)
                z /= np.linalg.norm(z)
        found[:, k] = z
    return found


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, largest first, and unit eigenvectors as columns.

    Of the two signs that with the larger entry of the largest size (the first of equal ones) is taken.
    """
    size = np.abs(matrix).max(initial=0.0)
    k = min(k, len(matrix))
    if not size:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading(diagonal, off, k)
    found = vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        found[at + 1 :] -= 2 * np.outer(v, v @ found[at + 1 :])
    found /= np.linalg.norm(found, axis=0)
    largest = found[np.abs(found).argmax(axis=0), np.arange(k)]
    return values * size, found * np.where(largest < 0, -1.0, 1.0)


def _projected(middle: Centre, turned: np.ndarray):
    """Rows (key, component, deviation, whitened) of a batch (key, x)."""
    k = turned.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            every = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(every),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(middle.deviations(x), pa.int64()).take(every),
                    pa.array((middle.centred(x) @ turned).ravel()),
                ],
                names=[batch.schema.names[0], "component", "deviation", "whitened"],
            )

    return run


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row and component: `key`, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    bounded(spark)
    every = quantised(rows.select(F.col(key), F.col(vector).alias("_vector")), "_vector", "_x")
    kind = rows.schema[key].dataType.simpleString()
    # narrow once written: whole numbers of a small range take few bits each
    distinct = scratch.stage(every.select("_x").distinct(), "vectors")
    lengths = distinct.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    columns = f"`{key}` {kind}, component int, deviation long, whitened double"
    middle = None
    if lengths is not None:
        fit = distinct.where(F.size("_x") == lengths["d"])
        middle = centre(fit)
    if middle is None:
        nothing = spark.createDataFrame([], columns)
        return _named(nothing, key, 0, [], 0.0)
    matrix = covariance(fit, middle)
    values, turned = principal(matrix, components)
    spread = values > len(matrix) * 8 * _EPS * max(values[0], 0.0)
    values, turned = values[spread], turned[:, spread] / np.sqrt(values[spread])
    shared = spark.sparkContext.broadcast((middle, turned))
    if not len(values):
        return _named(spark.createDataFrame([], columns), key, middle.n, [], 0.0)

    def seen(x: np.ndarray) -> np.ndarray:
        where, directions = shared.value
        return where.centred(x) @ directions

    error = float(np.abs(_covariance(fit, seen, middle.n) - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _projected(*shared.value)(batches)

    found = every.where(F.size("_x") == lengths["d"]).select(key, "_x").mapInArrow(project, columns)
    return _named(found, key, middle.n, (values / np.trace(matrix)).tolist(), error)


def _named(found: DataFrame, key: str, n: int, explained: list[float], error: float) -> DataFrame:
    shares = F.array(*[F.lit(float(e)) for e in explained]) if explained else F.array(F.lit(0.0))
    return found.select(
        F.col(key),
        F.col("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation"),
        F.col("whitened"),
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
