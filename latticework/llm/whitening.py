"""Operator 11: whitening of embeddings with a covariance by polarisation.

Entries become whole numbers, x = floor(256 * c), so that every sum is exact.  With n different vectors and sums S,
``n*x - S`` is n times the centred entry, a whole number again.  Each task adds the squares of these numbers, for every
dimension and for the sum of every two dimensions; half the difference of those variances is the covariance,

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2,

so only sums of squares are shuffled: dimensions * (dimensions + 1) / 2 of them a task, whatever the rows.  Numbers
leave a task as digits to the base 2^40, which Spark adds in long columns without loss.  The matrix is put together on
the driver, exactly, divided once and given to ``eigh``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table

SCALE, COMPONENTS = 256, 4
#: A finite entry of this size or more has no long ``floor(256 * c)`` and counts as non-finite.
LARGEST = float(2**63 // SCALE)
#: Digits to the base 2^40 of one number; a number may have 280 bits.
_DIGITS, _BASE = 7, 40
_SCHEMA = "a int, b int, " + ", ".join(f"d{k} long" for k in range(_DIGITS))
#: Numbers of one block of rows times pairs in memory.
_BLOCK = 1 << 21


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64)


def _numbers(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Whole numbers of any size as rows of digits; the last digit carries the sign."""
    columns: list[list[int]] = [[] for _ in range(2 + _DIGITS)]
    for (a, b), v in sums.items():
        columns[0].append(a)
        columns[1].append(b)
        for k in range(_DIGITS):
            columns[2 + k].append(v & (1 << _BASE) - 1 if k < _DIGITS - 1 else v)
            v >>= _BASE
    names = ["a", "b", *[f"d{k}" for k in range(_DIGITS)]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(columns)], names)


def _added(df: DataFrame, task: Callable[[Iterable[pa.RecordBatch]], dict[tuple[int, int], int]]) -> dict[tuple[int, int], int]:
    """The sums of what tasks return, by key; as many numbers as dimensions, or pairs of them, reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _numbers(task(batches))

    rows = df.mapInArrow(run, _SCHEMA).groupBy("a", "b").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(_DIGITS)]).collect()
    return {(r.a, r.b): sum(r[2 + k] << _BASE * k for k in range(_DIGITS)) for r in rows}


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, as long numbers where they fit with room for a sum of two, else as Python's whole numbers."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, total), default=0)
    kind = np.int64 if most < 1 << 61 else object
    return x.astype(kind) * (n if kind is object else np.int64(n)) - np.array(total, kind)


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each column: long numbers are taken in three parts, of 21 bits and what is above."""
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(axis=0)] if len(y) else [0] * y.shape[1]
    low, mid, high = y & 0x1FFFFF, y >> 21 & 0x1FFFFF, y >> 42
    parts = ((0, low, low), (22, low, mid), (42, mid, mid), (43, low, high), (64, mid, high), (84, high, high))
    sums = [np.einsum("ij,ij->j", p, q).tolist() for _, p, q in parts]
    return [sum(v << shift for (shift, _, _), v in zip(parts, column, strict=True)) for column in zip(*sums, strict=True)]


def _totals(batches: Iterable[pa.RecordBatch]) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {(-1, -1): 0}
    for batch in batches:
        x = _matrix(batch)
        out[-1, -1] += len(x)
        low, high = (x & (1 << 32) - 1).sum(axis=0), (x >> 32).sum(axis=0)
        for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            out[k, k] = out.get((k, k), 0) + a + (b << 32)
    return out


def _polarised(n: int, total: list[int]) -> Callable[[Iterable[pa.RecordBatch]], dict[tuple[int, int], int]]:
    def task(batches: Iterable[pa.RecordBatch]) -> dict[tuple[int, int], int]:
        out: dict[tuple[int, int], int] = {}
        for batch in batches:
            z = centred(_matrix(batch), n, total)
            step = max(1, min(1 << 18, _BLOCK // max(1, len(total))))
            for at in range(0, len(z), step):
                rows = z[at : at + step]
                for i in range(len(total)):
                    own = squares(rows[:, i : i + 1])
                    pairs = squares(rows[:, i + 1 :] + rows[:, i : i + 1])
                    for j, v in zip(range(i, len(total)), own + pairs, strict=True):
                        out[i, j] = out.get((i, j), 0) + v
        return out

    return task


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, S, V) of the vectors in column ``x``: exact until the one division of each entry."""
    sums = _added(fit, _totals)
    n, total = sums[-1, -1], [sums[k, k] for k in range(len(sums) - 1)]
    if n == 0:
        return 0, [], np.zeros((0, 0))
    q, d = _added(fit, _polarised(n, total)), len(total)
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = q[i, i] / n**3 if i == j else (q[i, j] - q[i, i] - q[j, j]) / (2 * n**3)
    return n, total, v


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit vectors as rows); the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors.T[::-1][:count]
    sign = np.array([np.sign(w[np.argmax(np.abs(w))]) for w in vectors])
    return values, vectors * sign[:, None]


def _projected(n: int, total: list[int], vectors: np.ndarray, scale: np.ndarray):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(_matrix(batch), n, total)
            y = (z / n).astype(np.float64) @ vectors.T * scale
            whole = [v if v < 1 << 63 else None for v in squares(np.ascontiguousarray(z.T))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(whole, pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return run


def whiten(embeddings: DataFrame, count: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows vec_id, component, n, deviation, whitened, explained, identity_error, for each row with a usable vector.

    Rows whose vector is null, or holds null, NaN, infinite or (``LARGEST``) unbounded entries, are dropped.  Vectors of
    different lengths cannot share a covariance: those of the length that most rows have stay (of two such lengths, the
    larger).  Rows that repeat a vector count once in the fit and are all returned; so are rows that repeat an id, or
    have none.  Vectors with fewer dimensions than ``count`` have that many components.  Where an eigenvalue is not
    positive (all vectors alike) ``whitened`` is 0, so ``identity_error`` is 1 then, and ``explained`` is 0.
    ``deviation`` is null where it exceeds a long.  An empty table, or no usable vector, gives no rows.  Further columns
    are not looked at.  The driver holds dimensions^2 numbers.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).where(_usable(F.col("v")))
    rows = cut(rows.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (lengths.d if lengths else 0))
    fit = cut(rows.select("x").distinct(), "fit")
    n, total, v = covariance(fit)
    values, vectors = components(v, count) if total else (np.zeros(0), np.zeros((0, 0)))
    trace = float(np.trace(v))
    positive = values > trace * 1e-15
    scale = np.where(positive, 1 / np.sqrt(np.where(positive, values, 1)), 0)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    run = _projected(n, total, vectors, scale)
    error = _identity_error(fit.select(F.lit(0).cast(kind).alias("vec_id"), "x").mapInArrow(run, schema), len(values))
    discard(fit)
    explained = F.array(*[F.lit(float(e / trace if trace > 0 else 0)) for e in values]) if len(values) else F.array().cast("array<double>")
    return rows.mapInArrow(run, schema).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")
    )


def _identity_error(fit: DataFrame, count: int) -> float:
    """The largest entry of the whitened vectors' covariance less the identity; Spark's covariance is centred."""
    if not count:
        return 0.0
    w = [F.get("whitened", F.lit(k)) for k in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    row = fit.agg(*[F.covar_pop(w[i], w[j]) for i, j in pairs]).first()
    return max((abs(c - (i == j)) for (i, j), c in zip(pairs, row, strict=True) if c is not None), default=0.0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
