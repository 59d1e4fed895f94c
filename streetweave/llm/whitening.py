"""Whitening of embeddings by their principal components.

Entries are put on a grid of 1/64, so that counts, sums and the scatter are whole numbers and come out the
same however the rows are dealt. Each task sums its rows, Spark adds the sums up; what reaches the driver has
the size of the model, dimensions times dimensions, whatever the number of rows.

The scatter is taken of grid points less the whole part of their mean, and what the rest of the mean adds is
removed exactly before anything is rounded. Its pivoted Cholesky factor stops at the numerical rank. One-sided
Jacobi turns the columns of the triangular factor until they are orthogonal: their squared norms are the
eigenvalues, the columns at unit length the components. No cancellation of a large product is involved, so
small eigenvalues are as exact as large ones.

A vector that is null, holds a null, a NaN or an infinity, or an entry of 2**41 or more, is left out. So are
vectors of another length than the most frequent one (the longer of two). Repeated rows count as often as they
occur; a null vec_id is an id like any other. Directions without variance have no component, so constant
vectors, a single row and an empty table give no rows. A deviation beyond 64 bits is null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from streetweave.llm.shared import discard, land

#: The grid: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on count as not finite; squares of their grid points still add up in 38 digits.
_LARGEST = 2.0**41
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """Of ``n`` vectors: sums of x and of y = x - base by dimension, components as columns, their eigenvalues,
    the trace of the covariance, and the largest entry of the whitened covariance off the identity."""

    n: int
    sums: tuple[int, ...]
    base: tuple[int, ...]
    rest: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]


def _points(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(usable rows, lengths, offsets, grid points of all entries) of a list array."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    c = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    fine = np.abs(c) < _LARGEST  # false for NaN
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~fine)])
    usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    usable &= lengths == dims if dims else lengths > 0
    return usable, lengths, offsets, np.floor(SCALE * np.where(fine, c, 0.0)).astype(np.int64) + SHIFT


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """The usable rows of each batch, as rows of a matrix of grid points."""
    for batch in batches:
        usable, _, offsets, x = _points(batch.column(0), dims)
        if usable.any():
            yield x[offsets[:-1][usable][:, None] + np.arange(dims)]


def _gram(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers as Python integers, exact: in doubles, or in 64 bits, as far as these reach."""
    most = int(np.abs(y).max()) ** 2 * len(y)
    if most < 1 << 53:
        d = y.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    return (y.T @ y).astype(object) if most < 1 << 63 else y.astype(object).T @ y.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        usable, lengths, offsets, x = _points(batch.column(0))
        for size in np.unique(lengths[usable]).tolist():
            rows = x[offsets[:-1][usable & (lengths == size)][:, None] + np.arange(size)]
            old = found.setdefault(size, [0, 0])
            # 2**47 times the rows of a batch stays within 64 bits
            found[size] = [old[0] + len(rows), old[1] + rows.sum(axis=0).astype(object)]
    flat = [(size, j, n, int(s)) for size, (n, each) in found.items() for j, s in enumerate(each)]
    columns = list(zip(*flat, strict=True)) if flat else [()] * 4
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["dims", "j", "n", "s"])


def _scatters(base: tuple[int, ...]) -> Callable:
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for x in _batches(batches, len(base)):
            got = _gram(x - np.array(base, np.int64))
            total = got if total is None else total + got
        if total is None:
            return
        i, j = np.triu_indices(len(base))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].tolist(), pa.decimal128(38, 0))], ["i", "j", "v"])

    return scatter


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L' but for what lies below the accuracy of v; as many columns as the rank of v. The rows
    are in the order of v: L is triangular once they are put in the order of the pivots."""
    left = np.diag(v).astype(float).copy()
    least = len(v) * _EPS * left.max(initial=0.0)
    factor, done = np.zeros((len(v), len(v))), np.zeros(len(v), bool)
    for k in range(len(v)):
        p = int(np.where(done, -1.0, left).argmax())
        if left[p] <= least:
            return factor[:, :k]
        column = (v[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[done], column[p] = 0.0, np.sqrt(left[p])
        factor[:, k] = column
        done[p] = True
        left -= column**2
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns turned by plane rotations until they are orthogonal. All pairs of a round are disjoint
    (a round-robin), so a round is one step on matrices."""
    a = factor.copy()
    r = a.shape[1]
    if r < 2:
        return a
    seats = list(range(r + r % 2))  # an odd number gets an empty seat
    for _ in range(sweeps):
        turned = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(x, y) for x, y in zip(seats[:half], reversed(seats[half:]), strict=True) if x < r and y < r]
            p, q = (np.array(side) for side in zip(*pairs, strict=True))
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.where(size > 0, np.abs(gamma) / np.where(size > 0, size, 1.0), 0.0)
            turned = max(turned, float(off.max()))
            live = off > _EPS
            zeta = (beta - alpha) / np.where(live, 2 * gamma, 1.0)
            t = np.where(live, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * ap - c * t * aq, c * t * ap + c * aq
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if turned <= 4 * r * _EPS:
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and unit eigenvectors as columns; only those of its rank."""
    a = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, a[:, order] / norms[order]


def fit(rows: DataFrame, vector: str = "embedding", k: int | None = None) -> Whitening | None:
    """The whitening of a column of vectors, with the first ``k`` components or all; None without vectors."""
    vectors = rows.select(F.col(vector).alias("v"))
    summed = land(vectors.mapInArrow(_sums, "dims int, j int, n long, s decimal(38,0)").groupBy("dims", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "whitening-sums")
    most = summed.where("j = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not most:
        discard(summed)
        return None
    dims, n = most[0].dims, int(most[0].n)
    sums = tuple(int(r.s) for r in sorted(summed.where(F.col("dims") == dims).collect(), key=lambda r: r.j))
    discard(summed)
    base = tuple(s // n for s in sums)
    rest = tuple(s - n * b for s, b in zip(sums, base, strict=True))
    parts = vectors.mapInArrow(_scatters(base), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    v = np.zeros((dims, dims))
    for r in parts.collect():  # a row for each pair of dimensions
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.v) - rest[r.i] * rest[r.j]) / (n * n)
    trace = float(np.trace(v))
    values, components = eigen(v)
    model = Whitening(n, sums, base, rest, components[:, :k], values[:k], trace)
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(vectors, model)})


def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    y = x - np.array(model.base, np.int64) - np.array(model.rest, float) / model.n
    return y @ (model.components / np.sqrt(model.eigenvalues))


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Measured on the whitened rows, in a pass of its own."""
    dims, k = len(model.base), len(model.eigenvalues)
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x in _batches(batches, dims):
            w = _project(x, model)
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums of (n x - S)**2 over the dimensions, exact; None beyond 64 bits."""
    y, n = x - np.array(model.base, np.int64), model.n
    most = n * int(np.abs(y).max(initial=0)) + max(model.rest)
    if most * most * len(model.base) < 1 << 63:
        d = n * y - np.array(model.rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * y.astype(object) - np.array(model.rest, object)
    return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def whitened(vector: Column, model: Whitening) -> Column:
    """A struct of deviation (long) and whitened (a double for each component); null where the vector is left out."""
    dims, k = len(model.base), len(model.eigenvalues)

    @arrow_udf("deviation long, whitened array<double>")
    def apply(vectors: pa.Array) -> pa.Array:
        usable, _, offsets, points = _points(vectors, dims)
        x = points[offsets[:-1][usable][:, None] + np.arange(dims)]
        w = _project(x, model)
        deviation = np.full(len(vectors), None, object)
        deviation[usable] = _deviations(x, model)
        ends = np.concatenate([[0], np.cumsum(np.where(usable, k, 0))]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([pa.array(deviation.tolist(), pa.int64()), each], ["deviation", "whitened"], mask=pa.array(~usable))

    return apply(vector)


def whitened_rows(rows: DataFrame, k: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable
    vector and each of the first ``k`` components."""
    columns = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, "embedding", k)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], columns.format(id=rows.schema["vec_id"].dataType.simpleString()))
    each = rows.select("vec_id", whitened(rows["embedding"], model).alias("w")).where("w IS NOT NULL")
    flat = each.select("vec_id", F.posexplode("w.whitened").alias("at", "whitened"), F.col("w.deviation").alias("deviation"))
    explained = F.element_at(F.array(*[F.lit(e) for e in model.explained]), F.col("at") + 1)
    return flat.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
