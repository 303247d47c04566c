"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

1. Entries become whole numbers (64ths, moved by a million), and every distinct vector counts once:
   the fit list, written once.
2. One pass adds up the entries exactly, a second the products of the entries centred on their
   whole-number mean. Tasks send sums only, at most one row for each pair of dimensions.
3. The covariance, dimensions x dimensions, is factored on the driver: a Cholesky factor with the
   largest remaining variance as the next pivot, then plane rotations of the factor's columns until
   all are orthogonal. Squared column norms are the eigenvalues, the normalised columns the components.
4. A third pass measures the covariance of the whitened fit list. Rows are projected where they lie.

Null vectors and those that are empty or hold a null or non-finite entry take no part, nor do
vectors of another length than the most frequent one (of equally frequent ones, the smallest).
Entries beyond 2^61 / 64 count as that bound. Rows that repeat an id or a vector are projected one by
one. Components of no variance can't be whitened: there are as many as the fit list has rank, at most
the number asked for; an empty table, or one with a single distinct vector, has none. Equal
eigenvalues have any orthogonal components. Memory of the driver and of a task is the square of
the dimensions. Only the id and the vector column are read, so other columns can't clash; an id
column named like a result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.plans.tables import stored

# Entries are counted in 64ths and moved by a million.
PARTS, SHIFT = 64, 1_000_000
MOST = float(2**61)
# Variance below this share of the largest, times the dimensions, is rounding.
ROUNDING = 16 * np.finfo(float).eps
RESULTS = ("deviation", "whitened")


@dataclass(frozen=True)
class Whitening:
    n: int                      # distinct vectors
    sums: list[int]             # per dimension, exact
    components: np.ndarray      # dimensions x components
    eigenvalues: np.ndarray     # falling
    explained: np.ndarray       # shares of the whole variance
    identity_error: float       # of the whitened fit list's covariance

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole-number mean of every dimension, and what is left of it, below one."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, whole, strict=True)])


def usable(vector: str) -> Column:
    """Whether a vector is there, not empty and all finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def whole_numbers(vector: str) -> Column:
    """floor(64 c) + 1,000,000 of every entry."""
    bounded = lambda c: F.greatest(F.least(c.cast("double") * PARTS, F.lit(MOST)), F.lit(-MOST))
    return F.transform(vector, lambda c: F.floor(bounded(c)).cast("bigint") + SHIFT)


def _counted(vectors: DataFrame, id: str, vector: str, dimensions: int | None = None) -> DataFrame:
    rows = vectors.where(usable(vector))
    if dimensions is not None:
        rows = rows.where(F.size(vector) == dimensions)
    return rows.select(F.col(id), whole_numbers(vector).alias("__x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, rows)), pa.array(high),
                                               pa.array(low)], ["j", "rows", "high", "low"])

        for batch in batches:
            x = _matrix(batch.column(0), width)
            rows, high, low = rows + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
            if rows >= 1 << 30:
                yield told()
                rows, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        if rows:
            yield told()

    return add


def _products(width: int, project):
    """Sums of the products of ``project(rows)``, column by column."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = project(batch.column(0))
            total = y.T @ y if total is None else total + y.T @ y
        if total is None:
            return
        i, j = np.tril_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    return add


def _added(rows: DataFrame, width: int, project) -> np.ndarray:
    parts = rows.mapInArrow(_products(width, project), "i long, j long, v double")
    out = np.zeros((width, width))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``l`` with ``l @ l.T == a``, its rows in the order of ``a`` and lower triangular in pivot order."""
    rest, size = a.diagonal().copy(), len(a)
    floor = ROUNDING * size * max(rest.max(initial=0.0), 0.0)
    factor, free = np.zeros((size, size)), np.ones(size, bool)
    for k in range(size):
        pivot = int(np.argmax(np.where(free, rest, -np.inf)))
        if not rest[pivot] > floor:
            return factor[:, :k]
        column = (a[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(rest[pivot])
        factor[free, k] = column[free]
        free[pivot] = False
        rest -= factor[:, k] ** 2
    return factor


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of ``factor @ factor.T``.

    Every round of a sweep rotates disjoint pairs of columns, all pairs meet once a sweep.
    """
    g = factor.copy()
    width = g.shape[1]
    seats = np.arange(width + width % 2)
    for _ in range(sweeps if width > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            real = (p < width) & (q < width)
            p, q = p[real], q[real]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            far = np.abs(c) > np.finfo(float).eps * np.sqrt(a * b)
            if far.any():
                turned = True
                p, q = p[far], q[far]
                slope = (b[far] - a[far]) / (2 * c[far])
                t = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1, slope))
                cos = 1 / np.hypot(1, t)
                left, right = g[:, p], g[:, q]
                g[:, p], g[:, q] = cos * left - cos * t * right, cos * t * left + cos * right
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    values = (g**2).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > ROUNDING * len(factor) * values.max(initial=0.0)]
    return values[order], g[:, order] / np.sqrt(values[order])


def fit(vectors: DataFrame, components: int = 16, id: str = "vec_id", vector: str = "embedding") -> Whitening:
    nothing = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    lengths = vectors.where(usable(vector)).groupBy(F.size(vector).alias("width")).count()
    widest = lengths.orderBy(F.desc("count"), "width").first()
    if widest is None:
        return nothing
    width = widest["width"]
    fit_list = stored(_counted(vectors, id, vector, width).select("__x").distinct(), "fit-list")
    parts = fit_list.mapInArrow(_sums(width), "j long, rows long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("rows", "high", "low")]
    told = sorted(parts.groupBy("j").agg(*exact).collect())
    model = Whitening(int(told[0]["rows"]), [(int(r["high"]) << 32) + int(r["low"]) for r in told], np.zeros((width, 0)),
                      np.zeros(0), np.zeros(0), 0.0)
    whole, rest = model.mean
    # Products of whole numbers, exact below 2^53. What is left of the mean is taken off in whole numbers too.
    products = _added(fit_list, width, lambda column: (_matrix(column, width) - whole).astype(float))
    left = [s - int(m) * model.n for s, m in zip(model.sums, whole, strict=True)]
    covariance = np.array([[(int(products[i, j]) * model.n - left[i] * left[j]) / model.n**2 for j in range(width)]
                           for i in range(width)])
    values, directions = jacobi(pivoted_cholesky(covariance))
    values, directions = values[:components], directions[:, :components]
    if not len(values):
        return model
    scaled = directions / np.sqrt(values)
    square = _added(fit_list, len(values), lambda column: (_matrix(column, width) - whole - rest) @ scaled) / model.n
    return Whitening(model.n, model.sums, directions, values, values / covariance.trace(),
                     float(np.abs(square - np.eye(len(values))).max()))


def _deviations(x: np.ndarray, whole: np.ndarray, left: list[int], n: int) -> pa.Array:
    """Sum over the dimensions of (n x - sum)^2, exact; null where a long can't hold it."""
    centred = x - whole
    bound = float(n) * (np.abs(centred).max(initial=0).astype(float) + 1)
    if bound * bound * x.shape[1] < 2.0**62:
        return pa.array(((n * centred - np.array(left, np.int64)) ** 2).sum(1), pa.int64())
    told = [sum((n * int(c) - s) ** 2 for c, s in zip(row, left, strict=True)) for row in centred]
    return pa.array([t if t < 2**63 else None for t in told], pa.int64())


def transform(vectors: DataFrame, model: Whitening, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, deviation, whitened`` of every usable row: the exact deviation, and an array of one number a component."""
    if id in RESULTS:
        raise ValueError(f"the id column can't be named {id}")
    kind = vectors.schema[id]
    schema = T.StructType([kind, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if not model.n:
        return vectors.sparkSession.createDataFrame([], schema)
    width, count = model.components.shape
    whole, rest = model.mean
    left = [s - int(m) * model.n for s, m in zip(model.sums, whole, strict=True)]
    scaled, n = model.components / np.sqrt(model.eigenvalues), model.n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            z = (x - whole - rest) @ scaled
            offsets = pa.array(np.arange(0, len(x) * count + 1, count, dtype=np.int32) if count else np.zeros(len(x) + 1, np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(z).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _deviations(x, whole, left, n), lists], [id, *RESULTS])

    return _counted(vectors, id, vector, width).mapInArrow(project, schema)
