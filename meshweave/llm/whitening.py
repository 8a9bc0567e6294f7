"""Whitening of embeddings: principal components of all distinct vectors, scaled to
variance 1.

Entries become whole numbers x = floor(256 c). Each task goes through its part of the
distinct vectors once and keeps count, sums, mean and scatter by Welford's rank-one
updates; parts are merged by the update for two sets of rows, some at a time, in tasks, so
that one matrix of dimension x dimension reaches the driver, however many rows there are.
There Householder reflections and implicitly shifted QR steps solve for its eigenvalues.
Rows are then projected where they lie; a second pass over the distinct vectors measures
the covariance of what came out.

Defined cases: vectors that are null or hold null or non-finite entries are left out. Of
vectors of different lengths those of the most frequent length stay (of equal ones the
greatest). Repeated vectors count once in the fit and have a row each in the result; rows
with null ids are kept. Components whose variance is nothing beside the first's, as of a
single vector or a constant dimension, have no rows. x and sums that leave 64 bits are
worked on as Python's whole numbers; a deviation over 64 bits is null. An empty table, or
one without vectors, gives an empty result. Only id and vector are read, whatever other
columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.llm.common import pieces, stash

MOST = 4  # components
FAN = 32  # parts that one task merges
STATE = "part long, n long, sums array<string>, mean array<double>, scatter array<double>"
#: Share of the first component's variance under which there is no component: rounding.
NOTHING = 1e-11


@dataclass
class Moments:
    """Of rows of numbers: count, exact sums, mean, and the sum of squares about it."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def add(self, block: np.ndarray) -> None:
        """Rank-one updates, a row at a time."""
        if block.dtype.kind == "i":
            whole = block if _size(block) * len(block) < 2**62 else block.astype(object)
            self.sums = [a + int(b) for a, b in zip(self.sums, whole.sum(axis=0), strict=True)]
        n, mean, scatter, step = self.n, self.mean, self.scatter, np.empty_like(self.scatter)
        for row in block.astype(float):
            n += 1
            off = row - mean
            mean += off / n
            np.multiply.outer(off, off * ((n - 1) / n), out=step)
            scatter += step
        self.n = n

    def merge(self, other: Moments) -> None:
        """Of both sets of rows, from those of each."""
        n = self.n + other.n
        if not other.n:
            return
        off = other.mean - self.mean
        self.scatter = self.scatter + other.scatter + np.multiply.outer(off, off) * (self.n / n * other.n)
        self.mean = self.mean + off * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self, part: int) -> pa.RecordBatch:
        cols = [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), pa.array([[str(s) for s in self.sums]], pa.list_(pa.string())), pa.array([self.mean.tolist()], pa.list_(pa.float64())), pa.array([self.scatter.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, ["part", "n", "sums", "mean", "scatter"])

    @classmethod
    def of(cls, row: dict) -> Moments:
        d = len(row["mean"])
        return cls(row["n"], [int(s) for s in row["sums"]], np.array(row["mean"], float), np.array(row["scatter"], float).reshape(d, d))


def _size(x: np.ndarray) -> int:
    """Of the largest entry, as a whole number of any size."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _block(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def moments(rows: DataFrame, d: int, project: tuple[np.ndarray, np.ndarray] | None = None) -> Moments:
    """Of column x of rows, or of its projection (centre, components as rows)."""
    width = d if project is None else len(project[1])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(width)
        for batch in pieces(batches, 4096):
            block = _block(batch.column("x"), d)
            state.add(block if project is None else (block - project[0]) @ project[1].T)
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Moments.empty(width)
        for batch in batches:
            for row in batch.to_pylist():
                if at is not None and row["part"] // FAN != at:
                    yield state.row(at)
                    state = Moments.empty(width)
                at = row["part"] // FAN
                state.merge(Moments.of(row))
        if at is not None:
            yield state.row(at)

    parts = stash(rows.select("x").mapInArrow(fold, STATE), "moments")
    while parts.count() > FAN:
        ahead = F.floor(F.col("part") / FAN)
        parts = stash(parts.repartition(ahead).sortWithinPartitions("part").mapInArrow(merged, STATE), "moments")
    # FAN matrices at most; merged by one task, so that the driver gets one.
    last = parts.coalesce(1).sortWithinPartitions("part").select(F.lit(0).cast("long").alias("part"), "n", "sums", "mean", "scatter").mapInArrow(merged, STATE).collect()
    return Moments.of(last[0].asDict()) if last else Moments.empty(width)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, as rows, of a symmetric matrix:
    reduced to three diagonals by reflections, then by QR steps with implicit shifts."""
    n = len(a)
    a, q = (a + a.T) / 2, np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = math.sqrt(x @ x)
        if norm == 0:
            continue
        x[0] += math.copysign(norm, x[0])
        x /= math.sqrt(x @ x)
        # (I - 2xx') A (I - 2xx') on the rest of the matrix, and q (I - 2xx').
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    q = np.ascontiguousarray(q.T)  # rotations act on rows
    hi, turns = n - 1, 0
    while hi > 0:
        small = [abs(e[i]) <= 1e-16 * (abs(d[i]) + abs(d[i + 1])) for i in range(hi)]
        if small[hi - 1]:
            e[hi - 1], hi, turns = 0.0, hi - 1, 0
            continue
        lo = hi - 1
        while lo > 0 and not small[lo - 1]:
            lo -= 1
        turns += 1
        if turns > 100 * n:
            raise ArithmeticError("QR steps don't converge")
        # Wilkinson's shift: the eigenvalue of the last 2 x 2 that is nearer to its end.
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    by = np.argsort(d)[::-1]
    return np.array(d)[by], q[by]


def vectors(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """Rows (key, x array<long>, d) of the vectors that are whole."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = rows.where(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long"))
    return whole.select(F.col(key), x.alias("x")).withColumn("d", F.size("x"))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = MOST) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error)."""
    rows = vectors(rows, vector, key)
    fit = stash(rows.select("d", "x").distinct(), "vectors")
    kind = rows.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = fit.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).take(1)
    if not lengths:
        return rows.sparkSession.createDataFrame([], shape)
    d = lengths[0]["d"]
    fit, rows = fit.where(F.col("d") == d), rows.where(F.col("d") == d)
    got = moments(fit, d)
    values, axes = eigen(got.scatter / got.n)
    few = sum(1 for v in values[:most] if v > NOTHING * values[0] and v > 0)
    axes = axes[:few] * np.where(axes[np.arange(few), np.abs(axes[:few]).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest entry is positive
    if not few:
        return rows.sparkSession.createDataFrame([], shape)
    centre = np.array([s / got.n for s in got.sums])  # of whole numbers: rounded once
    scaled = axes / np.sqrt(values[:few])[:, None]
    explained = values[:few] / math.fsum(values)
    after = moments(fit, d, (centre, scaled))
    error = float(np.abs(after.scatter / after.n - np.eye(few)).max())
    n, sums = got.n, got.sums

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            x, m = _block(batch.column("x"), d), batch.num_rows
            reach = n * _size(x) + max(map(abs, sums))
            exact = x if d * reach * reach < 2**63 else x.astype(object)
            off = n * exact - np.array(sums, exact.dtype)
            deviation = [v if v < 2**63 else None for v in map(int, (off * off).sum(axis=1))]
            out = (x - centre) @ scaled.T
            repeat = np.repeat(np.arange(m), few)
            cols = [batch.column(0).take(pa.array(repeat)), np.tile(np.arange(1, few + 1, dtype=np.int32), m), np.full(m * few, n), pa.array(deviation, pa.int64()).take(pa.array(repeat)), out.ravel(), np.tile(explained, m), np.full(m * few, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(apply, shape)
