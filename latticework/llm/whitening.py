"""Embedding whitening: leading principal components of all vectors, each scaled to unit variance.

Exact sums and centred products are gathered over all rows, task by task; only tables of the size of the covariance come
to the driver. There a Householder reduction makes the matrix tridiagonal, Sturm counts bisect for the leading
eigenvalues, and inverse iteration gives their vectors, kept orthogonal inside clusters of close eigenvalues. The small
projection then travels with the tasks. Work on the driver depends on the dimension alone, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

COMPONENTS = 32
# Entries become whole numbers: floor(GRID * entry) + OFFSET.
GRID, OFFSET = 64, 1_000_000
# Components below this share of the largest eigenvalue hold rounding errors only and are left out.
LEAST_SHARE = 1e-10
# Eigenvalues closer than this share of the matrix norm form a cluster.
CLUSTER = 1e-3
# Vectors handled at once inside a task.
ROWS = 4096


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix by Householder reflections."""
    a, d = matrix.copy(), len(matrix)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        v = x.copy()
        length = np.linalg.norm(x)
        if length:
            v[0] += length if x[0] >= 0 else -length
            v /= np.linalg.norm(v)
            w = a[k + 1:, k + 1:] @ v
            w -= (w @ v) * v
            a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = -length if x[0] >= 0 else length
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def _below(diag: np.ndarray, off2: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each value: negative pivots of the Sturm sequence."""
    counts = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for i, value in enumerate(diag):
        pivot = value - at - (off2[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        counts += pivot < 0
    return counts


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    d = len(diag)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    size = max(abs(low[0]), abs(high[0]))
    tiny = max(np.finfo(float).eps ** 2 * size, np.finfo(float).tiny)
    high = high + 4 * np.finfo(float).eps * size
    rank = d - 1 - np.arange(k)  # of an eigenvalue, counted from below
    off2 = off ** 2
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return high
        under = _below(diag, off2, middle, tiny) > rank
        low, high = np.where(under, low, middle), np.where(under, middle, high)


def _solver(diag: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Solves (T - shift) z = b by elimination with row exchanges; a vanishing pivot becomes tiny."""
    d = len(diag)
    first, second, third = diag - shift, np.append(off, 0.0), np.zeros(d)
    factor, swapped = np.zeros(d), np.zeros(d, bool)
    for i in range(d - 1):
        lower, middle, upper = off[i], diag[i + 1] - shift, second[i + 1]
        if abs(lower) > abs(first[i]):
            swapped[i] = True
            f = first[i] / lower
            row = (second[i], third[i])
            first[i], second[i], third[i] = lower, middle, upper
            first[i + 1], second[i + 1] = row[0] - f * middle, row[1] - f * upper
        else:
            f = lower / (first[i] if abs(first[i]) > tiny else tiny)
            first[i + 1], second[i + 1] = middle - f * second[i], upper - f * third[i]
        factor[i] = f
    first = np.where(np.abs(first) < tiny, tiny, first)

    def solve(b: np.ndarray) -> np.ndarray:
        z = b.copy()
        for i in range(d - 1):
            if swapped[i]:
                z[i], z[i + 1] = z[i + 1], z[i]
            z[i + 1] -= factor[i] * z[i]
        for i in range(d - 1, -1, -1):
            ahead = second[i] * z[i + 1] if i + 1 < d else 0.0
            ahead += third[i] * z[i + 2] if i + 2 < d else 0.0
            z[i] = (z[i] - ahead) / first[i]
            if abs(z[i]) > 1e200:  # only the direction counts
                z *= 1e-200
        return z

    return solve


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest eigenvalues of a symmetric matrix."""
    d = len(matrix)
    k = min(k, d)
    scale = float(np.abs(matrix).max()) if d else 0.0
    if not scale:
        return np.zeros(k), np.eye(d)[:, :k]
    diag, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diag, off, k)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0))
    eps = np.finfo(float).eps
    vectors = np.zeros((d, k))
    cluster = 0  # where the present cluster begins
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * norm:
            cluster = i
        solve = _solver(diag, off, values[i] - (i - cluster) * eps * norm, eps * norm)
        z = np.random.default_rng(i).standard_normal(d)
        for _ in range(5):
            z = solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):  # a second sweep mends what the first one leaves by rounding
                z -= vectors[:, cluster:i] @ (vectors[:, cluster:i].T @ z)
            z /= np.linalg.norm(z)
        vectors[:, i] = z
    for j in range(d - 3, -1, -1):
        v = reflectors[j]
        vectors[j + 1:] -= 2 * np.outer(v, v @ vectors[j + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    return np.einsum("ij,ik,kj->j", vectors, matrix, vectors), vectors


def _whole(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of usable vectors, their entries as whole numbers): d entries each, none null or non-finite."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    entries = column.values
    gaps = np.zeros(len(entries), bool)
    if entries.null_count:
        gaps = entries.is_null().to_numpy(zero_copy_only=False)
        entries = entries.fill_null(0.0)
    numbers = entries.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(gaps | ~np.isfinite(numbers))])
    good = (np.diff(offsets) == d) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    kept = numbers[offsets[:-1][good, None] + np.arange(d)]
    most = float(1 << 62)  # entries beyond this are cut there, as a cast to long would do a little later
    return good, np.clip(np.floor(GRID * kept), -most, most).astype(np.int64) + OFFSET


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(d, np.int64)
    for batch in _slices(batches):
        x = _whole(batch.column(0), d)[1]
        n += len(x)
        total += x.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(total)], ["i", "n", "s"])


@dataclass
class Whitening:
    """Fitted on n vectors with the given sums: whitened = (x - sums / n) @ vectors / sqrt(values)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n without loss of digits: the whole part of the mean goes first."""
        whole = self.sums // max(self.n, 1)
        return (x - whole) - (self.sums - whole * self.n) / max(self.n, 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sums)^2, exact; null where it exceeds a long."""
        apart = self.n * x - self.sums
        if not len(x) or (apart.astype(float) ** 2).sum(axis=1).max() < 9e18:
            return (apart ** 2).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in apart]
        return [v if v < 1 << 63 else None for v in exact]


def _products(batches: Iterator[pa.RecordBatch], d: int, model: Whitening, mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sums of products of centred entries (of whitened ones, if their mean is given), a row for each pair of columns."""
    size = d if mean is None else len(mean)
    total, plain = np.zeros((size, size)), np.zeros(size)
    for batch in _slices(batches):
        x = _whole(batch.column(0), d)[1]
        c = model.centred(x) if mean is None else model.project(x) - mean
        total += c.T @ c
        plain += c.sum(axis=0)
    i, j = np.triu_indices(size)
    # the plain sums stand in column -1
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, np.arange(size)])), pa.array(np.concatenate([j, np.full(size, -1)])),
                                      pa.array(np.concatenate([total[i, j], plain]))], ["i", "j", "v"])


def _covariance(vectors: DataFrame, d: int, model: Whitening, mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, mean of what was multiplied)."""
    size = d if mean is None else len(mean)
    found = vectors.mapInArrow(lambda b: _products(b, d, model, mean), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out, plain = np.zeros((size, size)), np.zeros(size)
    for r in found.collect():  # as many rows as the covariance has entries
        if r.j < 0:
            plain[r.i] = r.v
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.v
    return out / model.n, plain / model.n


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of all usable vectors; None where there is no usable vector of at least one entry."""
    vectors = rows.select(vector)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    usual = (vectors.where(F.col(vector).isNotNull() & finite & (F.size(vector) > 0)).groupBy(F.size(vector).alias("d")).count()
             .orderBy(F.desc("count"), F.desc("d")).first())
    if usual is None:
        return None
    d = usual.d
    sums = vectors.mapInArrow(lambda b: _sums(b, d), "i long, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = sorted(sums.collect())  # a row per dimension
    model = Whitening(sums[0].n, np.array([r.s for r in sums]), np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance, rest = _covariance(vectors, d, model)
    values, found = leading_components(covariance, components)
    some = values > LEAST_SHARE * max(values.max(initial=0.0), 0.0)
    model.values, model.vectors, model.trace = values[some], found[:, some], float(np.trace(covariance))
    if some.any():
        mean = rest @ (model.vectors / np.sqrt(model.values))
        spread, _ = _covariance(vectors, d, model, mean)
        model.identity_error = float(np.abs(spread - np.eye(len(spread))).max())
    return model


def whiten(rows: DataFrame, model: Whitening | None, keep: list[str], vector: str = "embedding") -> DataFrame:
    """The columns `keep` of all usable rows with `deviation` and `whitened` (an array, one entry per component).

    Usable are vectors of the usual length (the most frequent one, of equals the longest) without null or non-finite
    entries; other rows are left out. Repeated rows and ids stay. Without usable rows nothing is returned, and vectors that
    are all equal have no component, so `whitened` is empty.
    """
    schema = StructType([*[rows.schema[c] for c in keep], StructField("deviation", LongType()),
                         StructField("whitened", ArrayType(DoubleType()))])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    names, types = schema.fieldNames(), [f.type for f in to_arrow_schema(schema)]
    d = len(model.sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            good, x = _whole(batch.column(len(keep)), d)
            flat = model.project(x)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [*[kept.column(k).cast(t) for k, t in zip(range(len(keep)), types)], pa.array(model.deviations(x), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())).cast(types[-1])], names)

    return rows.select(*keep, vector).mapInArrow(work, schema)
