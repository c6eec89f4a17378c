"""Whitening of embeddings: principal components of the centred scatter.

Entries become whole numbers (256ths, rounded down), so equal vectors are
equal exactly and their sums have no rounding. Every distinct vector counts
once. The scatter of the centred vectors is factored by Cholesky with
pivoting, and one-sided Jacobi rotations make the columns of the triangular
factor orthogonal: their squared norms are eigenvalues, the columns scaled to
length one are components. The scatter itself is never multiplied again, so
small eigenvalues keep their digits.

Rows meet only in a distinct and in sums: a task adds up its own vectors, and
what travels are a few numbers per pair of dimensions. The driver holds
matrices of dimension times dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of, stored

#: Steps of an entry of 1.0.
STEPS = 256
#: Beyond this size a double has no fraction left, and entries are bounded to it.
LARGEST = 1 << 53
#: Rows that are multiplied at once.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` distinct vectors with exact ``sums``, components in rows by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def whole(vectors: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a list column count (of the dimension, without nulls, NaN, infinities), and their whole numbers in rows."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    finite = np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    width = np.maximum(sizes, 0)
    ends = np.cumsum(width)
    bad = np.concatenate(([0], np.cumsum(~finite)))
    good = (sizes > 0) & (bad[ends] == bad[ends - width])
    if dimension is not None:
        good &= sizes == dimension
    if not good.any():
        return good, np.empty((0, dimension or 0), np.int64)
    entries = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)[np.repeat(good, width)]
    # Rounded down; bounded, so that no entry leaves the whole numbers.
    numbers = np.clip(np.floor(entries * STEPS), -LARGEST, LARGEST).astype(np.int64)
    return good, numbers.reshape(int(good.sum()), -1) if dimension else numbers


def keys(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """``key``: every row's whole numbers, in the narrowest type that holds all entries of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole(batch.column(0), dimension)
            top = np.maximum(x.max(axis=1), -1 - x.min(axis=1)) if len(x) else np.empty(0, np.int64)
            for kind, low, high in (("<i1", -1, 1 << 7), ("<i2", 1 << 7, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 62)):
                own = x[(top >= low) & (top < high)]
                if len(own):
                    data = own.astype(kind)
                    size = data.dtype.itemsize * dimension
                    offsets = np.arange(len(own) + 1, dtype=np.int32) * size
                    yield pa.record_batch({"key": pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])})

    return df.select(col_of(df, vector).alias("v")).mapInArrow(run, "key binary")


def unkeyed(column: pa.Array, dimension: int) -> np.ndarray:
    """The whole numbers of keys, in rows; their order is not kept."""
    found = [np.empty((0, dimension), np.int64)]
    values = column.to_pylist()
    for size in (1, 2, 4, 8):
        own = b"".join(v for v in values if len(v) == size * dimension)
        if own:
            found.append(np.frombuffer(own, f"<i{size}").reshape(-1, dimension).astype(np.int64))
    return np.concatenate(found)


def factor(scatter: np.ndarray) -> np.ndarray:
    """Cholesky with pivoting: columns ``L`` (as many as the rank) with ``L @ L.T`` equal to ``scatter``, rows in their old order."""
    rest, columns = scatter.copy(), []
    if not len(rest):
        return np.empty((0, 0))
    bar = len(rest) * np.finfo(float).eps * max(rest.diagonal().max(), 0)
    open_ = np.ones(len(rest), bool)
    while open_.any():
        pivot = int(np.argmax(np.where(open_, rest.diagonal(), -np.inf)))
        if rest[pivot, pivot] <= bar:
            break
        column = np.where(open_, rest[:, pivot], 0.0) / np.sqrt(rest[pivot, pivot])
        rest -= np.outer(column, column)
        open_[pivot] = False
        columns.append(column)
    return np.array(columns).T.reshape(len(rest), len(columns))


def jacobi(factor_: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns of the factor rotated pairwise until all are orthogonal.

    A sweep pairs every two columns once, in rounds of pairs that do not
    touch, as in a tournament; a round is one step of array work.
    """
    a = factor_.copy()
    if a.shape[1] < 2:
        return a
    if a.shape[1] % 2:
        a = np.column_stack((a, np.zeros(len(a))))
    m = a.shape[1]
    order = np.arange(m)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(m - 1):
            p, q = order[: m // 2], order[m // 2:][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, off.max())
            turn = off > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if worst <= 1e-15 * np.sqrt(len(a)):
            break
    return a


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter by falling size, and unit components in rows, each with its largest entry positive."""
    turned = jacobi(factor(scatter))
    norms = (turned * turned).sum(0) if turned.size else np.empty(0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    components = (turned[:, order] / np.sqrt(norms[order])).T
    for row in components:
        row *= np.sign(row[np.argmax(np.abs(row))])
    return norms[order], components


def dimension_of(df: DataFrame, vector: str) -> int | None:
    """The length that most whole vectors have, of equals the largest; None without one."""
    v = col_of(df, vector)
    clean = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # One row per length that occurs.
    first = df.filter(clean).groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else None


def _sums(table: DataFrame, dimension: int) -> tuple[int, tuple[int, ...]]:
    """Number and exact sums of the distinct vectors; entries are added in two halves, which cannot overflow in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = unkeyed(batch.column(0), dimension)
            n += len(x)
            high += (x >> 24).sum(0)
            low += (x & 0xFFFFFF).sum(0)
        if n:
            yield pa.record_batch({"i": np.arange(dimension, dtype=np.int32), "n": np.full(dimension, n, np.int64), "high": high, "low": low})

    parts = table.mapInArrow(run, "i int, n bigint, high bigint, low bigint")
    wide = lambda c: F.sum(F.col(c).cast("decimal(30,0)")).alias(c)
    rows = {r["i"]: r for r in parts.groupBy("i").agg(wide("n"), wide("high"), wide("low")).collect()}
    if not rows:
        return 0, ()
    return int(rows[0]["n"]), tuple((int(rows[i]["high"]) << 24) + int(rows[i]["low"]) for i in range(dimension))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - sums / n`` in doubles: the whole part of the mean is taken off exactly first."""
    whole_, rest = zip(*[divmod(s, n) for s in sums])
    return (x - np.array(whole_, np.int64)).astype(np.float64) - np.array([r / n for r in rest])


def _products(table: DataFrame, n: int, sums: tuple[int, ...], project: np.ndarray | None = None) -> np.ndarray:
    """Sum over the distinct vectors of the outer products of centred, and if given projected, entries."""
    dimension = len(sums)
    width = dimension if project is None else project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            x = unkeyed(batch.column(0), dimension)
            for at in range(0, len(x), BLOCK):
                c = centred(x[at:at + BLOCK], n, sums)
                c = c if project is None else c @ project
                total += c.T @ c
                seen = True
        if seen:
            i, j = np.triu_indices(width)
            yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    rows = table.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    made = np.zeros((width, width))
    i, j, s = (rows.column(k).to_numpy() for k in ("i", "j", "s"))
    made[i, j], made[j, i] = s, s
    return made


def fit(df: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """Components of the distinct whole vectors of ``df``; None if no vector counts.

    Null vectors, vectors with null, NaN or infinite entries and empty ones do
    not count, nor do those of another length than most have. Repeated rows
    count once. Components without variance are left out, so there may be
    fewer than asked for, none if all vectors are equal. Other columns are not
    read. Entries beyond 2^53 steps are bounded to it.
    """
    dimension = dimension_of(df, vector)
    if dimension is None:
        return None
    table = stored(keys(df, vector, dimension).distinct(), "whole_vectors")
    n, sums = _sums(table, dimension)
    scatter = _products(table, n, sums)
    values, found = principal(scatter)
    values, found = values[:components] / n, found[:components]
    error = 0.0
    if len(values):
        scale = (found / np.sqrt(values)[:, None]).T
        error = float(np.abs(_products(table, n, sums, scale) / n - np.eye(len(values))).max())
    return Whitening(n, sums, found, values, float(scatter.trace()) / n, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Exact sums of ``(n * x - sums) ** 2`` over the dimensions; null where no long holds it."""
    if not len(x):
        return pa.array([], pa.int64())
    bound = max(n * int(np.abs(x).max()), max(abs(s) for s in sums)) * 2
    if bound * bound * len(sums) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return pa.array((d * d).sum(1))
    d = x.astype(object) * n - np.array(sums, object)
    return pa.array([int(s) if s < 1 << 63 else None for s in (d * d).sum(1)], pa.int64())


def transform(df: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every vector that counts.

    A row per component and vector; null and repeated ids and repeated rows
    stay rows of their own. Without a model, components or rows there are no rows.
    """
    kind = df.select(col_of(df, id)).schema[0].dataType
    own = df.select(col_of(df, id).alias("id"), col_of(df, vector).alias("v"))
    schema = f"`{id.replace('`', '``')}` {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    n, sums, k = model.n, model.sums, len(model.eigenvalues)
    scale = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    explained, error = model.eigenvalues / model.trace, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = whole(batch.column(1), len(sums))
            white = centred(x, n, sums) @ scale
            rows = len(x)
            take = pa.array(np.repeat(np.flatnonzero(good), k))
            yield pa.record_batch([
                batch.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                deviations(x, n, sums).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(white.ravel()), pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error))], names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, schema)
