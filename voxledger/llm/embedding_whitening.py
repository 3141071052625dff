"""Embedding whitening: distributed centred covariance, leading eigenpairs, broadcast projection.

1. Every entry c of a vector becomes the whole number x = floor(``scale`` * c) + ``shift``; count and sums of the dimensions
   are exact integers.
2. Tasks add up outer products of centred rows (x - S/n); a task emits one row for each dimension, those are added by dimension
   in the order of the tasks, and d rows of d numbers come to the driver.
3. The d x d matrix is reduced to a tridiagonal one by Householder reflections; Sturm counts bisect for the largest
   eigenvalues; inverse iteration gives their vectors, made orthogonal within clusters of close eigenvalues; the reflections
   carry them back.
4. Mean and components are broadcast; each row is projected and divided by the roots of the eigenvalues.

Driver and tasks hold a few d x d matrices, whatever the number of rows.

Defined results: a null vector and one with a null or non-finite entry are left out, as are entries whose x is no
exact double (2^52 or more), and vectors of another length than the most frequent one (the longer of equally frequent ones). Null and
repeated ids are rows like others. An eigenvalue that is zero to rounding (2^-40 of the trace; n = 1, equal vectors) can't
be divided by: ``whitened`` is null there. ``deviation`` is null where it passes 64 bits. With fewer dimensions than components
there are as many as dimensions. Only vec_id and the vector are read; further columns may have any name. An empty table,
or one without vectors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 1 << 52


@dataclass(frozen=True)
class Parameters:
    components: int = 8
    scale: int = 1_024
    shift: int = 100_000
    rows: int = 4_096  # rows of a matrix product


@dataclass(frozen=True)
class Model:
    n: int
    sums: np.ndarray  # whole numbers, one a dimension
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # d x k
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.values > self.trace * 2.0**-40


# Eigenpairs of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal, and the unit vectors of the Householder reflections in their order."""
    a = np.array(matrix, np.float64)
    d = len(a)
    mirrors: list[np.ndarray] = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        length = np.linalg.norm(v)
        if length == 0 or not np.any(x[1:]):
            mirrors.append(np.zeros(d - k - 1))
            continue
        v /= length
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        x[:] = 0
        x[0] = -np.copysign(size, v[0])
        a[k, k + 1 :] = x
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def carried_back(vector: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the matrix before the reflections."""
    out = vector.copy()
    for k in reversed(range(len(mirrors))):
        out[k + 1 :] -= 2 * (mirrors[k] @ out[k + 1 :]) * mirrors[k]
    return out


def below(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each point."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    square = np.concatenate([[0.0], side**2])
    q = np.ones_like(at)
    count = np.zeros(len(at), int)
    for a, b2 in zip(diagonal, square, strict=True):
        q = a - at - (b2 / q if b2 else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    d = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(side)]) + np.concatenate([np.abs(side), [0.0]])
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    wide = max(abs(low), abs(high), np.finfo(float).tiny) * 1e-12
    lows, highs = np.full(k, low - wide), np.full(k, high + wide)
    wanted = d - 1 - np.arange(k)  # of rising order
    for _ in range(200):
        middle = (lows + highs) / 2
        if np.all((middle <= lows) | (middle >= highs)):
            break
        right = below(diagonal, side, middle) > wanted
        highs, lows = np.where(right, middle, highs), np.where(right, lows, middle)
    return (lows + highs) / 2


def _solve(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a zero pivot becomes a tiny one."""
    d = len(diagonal)
    tiny = max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0), 1e-300) * np.finfo(float).eps
    main, up, up2, x = diagonal - shift, np.append(side, 0.0), np.zeros(d), right.copy()
    for i in range(d - 1):
        low, following = side[i], (main[i + 1], up[i + 1])
        if abs(low) > abs(main[i]):
            factor = main[i] / low
            main[i], row_up, row_up2 = low, following[0], following[1]
            main[i + 1], up[i + 1] = up[i] - factor * row_up, -factor * row_up2
            up[i], up2[i] = row_up, row_up2
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            pivot = main[i] if main[i] else tiny
            main[i], factor = pivot, low / pivot
            main[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    for i in reversed(range(d)):
        tail = (up[i] * x[i + 1] if i + 1 < d else 0.0) + (up2[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] = (x[i] - tail) / (main[i] if abs(main[i]) > tiny else np.copysign(tiny, main[i]))
    return x


def leading_vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """Unit vectors by inverse iteration, orthogonal to those before them in a cluster of close eigenvalues."""
    d = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0), 1e-300)
    rng = np.random.default_rng(5)
    out = np.zeros((d, len(values)))
    start = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            start = k  # a new cluster
        # Equal eigenvalues are set a little apart, so each has a matrix of its own.
        shift = value - (k - start) * 4 * np.finfo(float).eps * size
        x = rng.standard_normal(d)
        for _ in range(steps):
            x = _solve(diagonal, side, shift, x / np.linalg.norm(x))
            for _ in range(2):
                x -= out[:, start:k] @ (out[:, start:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    top = np.abs(matrix).max(initial=0.0)
    if top == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, side, mirrors = tridiagonal(matrix / top)
    values = leading_values(diagonal, side, k)
    vectors = leading_vectors(diagonal, side, values)
    return values * top, np.stack([carried_back(v, mirrors) for v in vectors.T], axis=1)


# The table


def whole_numbers(vectors: DataFrame, column: str, p: Parameters = Parameters()) -> DataFrame:
    """(vec_id, x): usable vectors as arrays of whole numbers."""
    own = F.transform(column, lambda c: c.cast("double") * p.scale)
    rows = vectors.select("vec_id", own.alias("v")).filter("v is not null and size(v) > 0")

    def fits(c: Column) -> Column:
        return F.coalesce((F.abs(c) < EXACT - p.shift) & ~F.isnan(c), F.lit(False))

    def whole(c: Column) -> Column:
        return F.when(fits(c), F.floor(c) + p.shift)  # filters may look at the size of a row that another filter drops

    return rows.filter(F.forall("v", fits)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", whole).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            column = part.column("x")
            yield part, column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _exact_sums(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Dimensions, rows and sums of the most frequent length."""
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return 0, 0, np.zeros(0, np.int64)
    d, n = lengths["d"], lengths["count"]
    # 2^53 times fewer than 2^63 rows stay in 38 digits.
    sums = rows.filter(F.size("x") == d).select(F.posexplode("x").alias("dim", "c")).groupBy("dim").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    found = {r["dim"]: int(r["s"]) for r in sums.collect()}  # d rows
    return d, n, np.array([found[k] for k in range(d)], object)


def _added(parts: DataFrame, d: int) -> np.ndarray:
    """Sum of partial rows (i, task, row of d doubles), added in the order of the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                total[i] = total.get(i, 0.0) + np.frombuffer(raw)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["i", "row"])

    ordered = parts.repartition("i").sortWithinPartitions("i", "task")
    out = np.zeros((d, d))
    for r in ordered.mapInArrow(add, "i int, row binary").collect():  # d rows of d doubles
        out[r["i"]] = np.frombuffer(r["row"])
    return out


def _products(rows: DataFrame, d: int, of, p: Parameters) -> np.ndarray:
    """Sum over all rows of the outer product of ``of(matrix)`` rows, which have d entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, 0
        for part, matrix in _matrices(batches, p.rows):
            if total is None:
                total, task = np.zeros((d, d)), part.column("task")[0].as_py()
            values = of(matrix)
            total += values.T @ values
        if total is not None:
            yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([task] * d, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "task", "row"])

    return _added(rows.select("x", F.spark_partition_id().alias("task")).mapInArrow(run, "i int, task int, row binary"), d)


def fit(rows: DataFrame, p: Parameters = Parameters()) -> Model | None:
    """Leading components of :func:`whole_numbers` rows; None without rows."""
    d, n, sums = _exact_sums(rows)
    if not n:
        return None
    mean = _mean(sums, n)
    same = rows.filter(F.size("x") == d)
    covariance = _products(same, d, lambda x: _centred(x, mean), p) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_pairs(covariance, min(p.components, d))
    return Model(n, sums, values, vectors, float(np.trace(covariance)))


def _mean(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and broken part of each mean; together they have more digits than one double."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    return whole, np.array([(int(s) % n) / n for s in sums])


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - mean[0]) - mean[1]


def _projector(model: Model):
    mean = _mean(model.sums, model.n)
    scale = np.where(model.usable, 1 / np.sqrt(np.where(model.usable, model.values, 1.0)), 0.0)
    return lambda x: (_centred(x, mean) @ model.vectors) * scale


def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row; null where it passes 64 bits."""
    span = int(np.abs(x).max()) * model.n + max(abs(int(s)) for s in model.sums)
    if span < 1 << 62 and span * span * x.shape[1] < 1 << 62:  # all of it fits 64 bits: the same numbers, sooner
        away = model.n * x - model.sums.astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    # Exact at any size: whole numbers without bounds, one row at a time.
    out = (sum((model.n * c - s) ** 2 for c, s in zip(row.tolist(), model.sums, strict=True)) for row in x)
    return [v if v < 1 << 63 else None for v in out]


def identity_error(rows: DataFrame, model: Model, p: Parameters = Parameters()) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, over components that can be divided by."""
    k = len(model.values)
    project = _projector(model)
    # A column of ones carries the sums along.
    moments = _products(rows.filter(F.size("x") == len(model.sums)), k + 1, lambda x: np.hstack([project(x), np.ones((len(x), 1))]), p)
    mean = moments[:k, k] / model.n
    off = moments[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(off[np.ix_(model.usable, model.usable)]).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", p: Parameters = Parameters()) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row a vector and component."""
    rows = whole_numbers(vectors, column, p)
    model = fit(rows, p)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, model, p)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d x k numbers
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        project = _projector(own)
        k = len(own.values)
        explained = own.values / own.trace if own.trace else np.zeros(k)
        for part, matrix in _matrices(batches, p.rows):
            m = part.num_rows
            out = project(matrix)
            null = np.broadcast_to(~own.usable, out.shape).ravel()
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(_deviations(matrix, own), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n)), deviation, pa.array(out.ravel(), pa.float64(), mask=null), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.record_batch(columns, names=names)

    return rows.filter(F.size("x") == len(model.sums)).mapInArrow(run, SCHEMA)
