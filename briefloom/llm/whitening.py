"""Embedding whitening: moments by Welford's updates, eigenvectors of their covariance by symmetric QR.

Each task streams its vectors through rank-one updates of mean and scatter matrix, and keeps the exact sums. Results of
tasks are merged by the parallel update formula, FAN at a time. The covariance is brought to three diagonals by
reflections, and those to one by implicit QR steps. Vectors are then projected on the first components, each scaled to
variance one; the covariance of what comes out is measured in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stash
from .vector_arrays import matrices

#: Moments that are merged at one time.
FAN = 16
#: Of a matrix whose largest entry is 1, what is as good as 0.
NOTHING = 1e-20
_MOMENTS = pa.schema([("part", pa.int64()), ("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("origin", pa.list_(pa.int64())), ("mean", pa.binary()), ("scatter", pa.binary())])
_SQL = "part long, dims int, n long, sums array<string>, origin array<long>, mean binary, scatter binary"


class Moments:
    """Count, exact sums, mean and scatter matrix (the sum of outer products of what is centred).

    The mean of whole numbers is kept relative to the first of them, so that it loses nothing where they are large.
    """

    def __init__(self, dims: int):
        self.n, self.sums, self.origin, self.mean, self.scatter = 0, [0] * dims, np.zeros(dims, np.int64), np.zeros(dims), np.zeros((dims, dims))

    def add(self, x: np.ndarray) -> None:
        """Welford's update for each row; sums are kept if the rows are whole numbers."""
        if x.dtype.kind == "i":
            wide = x if np.abs(x).max(initial=0) < (1 << 62) // max(1, len(x)) else x.astype(object)
            self.sums = [a + int(b) for a, b in zip(self.sums, wide.sum(axis=0))]
            if not self.n:
                self.origin = x[0].copy() if len(x) else self.origin
            x = x - self.origin
        mean, scatter, n, step = self.mean, self.scatter, self.n, np.empty_like(self.scatter)
        for row in x.astype(np.float64):
            n += 1
            delta = row - mean
            mean += delta / n
            np.multiply.outer(delta, delta * ((n - 1) / n), out=step)
            scatter += step
        self.n = n

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        if not other.n:
            return
        if not self.n:
            self.origin = other.origin
        n = self.n + other.n
        delta = (other.origin - self.origin) + (other.mean - self.mean)
        self.scatter += other.scatter + np.outer(delta, delta) * (self.n / n * other.n)
        self.mean = self.mean + delta * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    @property
    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * max(1, self.n))

    def row(self, part: int) -> dict:
        return {"part": part, "dims": len(self.mean), "n": self.n, "sums": [str(s) for s in self.sums], "origin": self.origin.tolist(), "mean": self.mean.tobytes(), "scatter": self.scatter.tobytes()}

    @classmethod
    def of(cls, row: dict) -> Moments:
        out = cls(row["dims"])
        out.n, out.sums = row["n"], [int(s) for s in row["sums"]]
        out.origin, out.mean, out.scatter = np.array(row["origin"], np.int64), np.frombuffer(row["mean"]).copy(), np.frombuffer(row["scatter"]).reshape(row["dims"], -1).copy()
        return out


def _whole(x: np.ndarray, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows fit, floor(scale * x) + offset of those as int64)."""
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    fits = (np.abs(x) < float(1 << 62)).all(axis=1)
    return fits, x[fits].astype(np.int64) + offset


def _moments(rows: DataFrame, scale: float | None, offset: int) -> DataFrame:
    """Moments of each task's vectors (v), by their length; of whole numbers if there is a scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for _, x in (m for m in matrices(batch.column("v")) if m[1].shape[1]):
                held.setdefault(x.shape[1], Moments(x.shape[1])).add(_whole(x, scale, offset)[1] if scale else x)
        part = TaskContext.get().partitionId()
        yield from pa.Table.from_pylist([m.row(part) for m in held.values() if m.n], _MOMENTS).to_batches()

    return rows.mapInArrow(run, _SQL)


def _merged(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    out = Moments(table.column("dims")[0].as_py())
    for i in range(table.num_rows):
        out.merge(Moments.of(table.slice(i, 1).to_pylist()[0]))
    return pa.Table.from_pylist([out.row(table.column("part")[0].as_py() // FAN)], _MOMENTS)


def moments(rows: DataFrame, scale: float | None = None, offset: int = 0) -> Moments | None:
    """Moments of the vectors (v) of the length that most of them have (of lengths as frequent: the largest). None without vectors."""
    parts = stash(_moments(rows, scale, offset))
    lengths = parts.groupBy("dims").agg(F.sum("n").alias("n"), F.max("part").alias("last")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return None
    parts, last = parts.where(F.col("dims") == lengths["dims"]), lengths["last"]
    while last >= FAN:  # so many parts are merged at one time, until the last few come to the driver
        parts = stash(parts.groupBy(F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(_merged, _SQL))
        last //= FAN
    out = Moments(lengths["dims"])
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        out.merge(Moments.of(r.asDict()))
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, beside it, rows q) with q @ a @ q.T of three diagonals, by Householder's reflections. Entries of ``a`` are 1 at most."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.abs(v[1:]).max() <= NOTHING:
            a[k + 2 :, k] = a[k, k + 2 :] = 0
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        side = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = side
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as rows) of a symmetric matrix: QR steps with Wilkinson's shift, by Givens rotations."""
    size = float(np.abs(a).max(initial=0)) or 1.0
    d, e, z = tridiagonal(a / size)
    eps, m, steps = np.finfo(float).eps, len(d) - 1, 0
    while m > 0:
        small = np.abs(e[:m]) <= np.maximum(NOTHING, eps * (np.abs(d[:m]) + np.abs(d[1 : m + 1])))
        e[:m][small] = 0
        if e[m - 1] == 0:
            m -= 1
            continue
        low = m - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        if (steps := steps + 1) > 60 * len(d):
            raise ArithmeticError("eigenvalues don't settle")
        half = (d[m - 1] - d[m]) / 2
        shift = d[m] - e[m - 1] ** 2 / (half + np.copysign(np.hypot(half, e[m - 1]), half))
        x, y = d[low] - shift, e[low]
        for k in range(low, m):
            r = np.hypot(x, y)
            c, s = (x / r, y / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, b, q = d[k], e[k], d[k + 1]
            d[k], d[k + 1], e[k] = c * c * p + 2 * c * s * b + s * s * q, s * s * p - 2 * c * s * b + c * c * q, c * s * (q - p) + (c * c - s * s) * b
            if k < m - 1:
                x, y = e[k], s * e[k + 1]
                e[k + 1] *= c
            z[k], z[k + 1] = c * z[k] + s * z[k + 1], c * z[k + 1] - s * z[k]
    order = np.argsort(-d, kind="stable")
    return d[order] * size, z[order]


def _squares(from_mean: np.ndarray) -> list[Decimal | None]:
    """Sums of squares of rows of whole numbers; None beyond 38 digits."""
    if not np.abs(from_mean).max(initial=0) < np.sqrt((1 << 62) / max(1, from_mean.shape[1])):
        from_mean = from_mean.astype(object)
    return [Decimal(s) if s < 10**38 else None for s in (from_mean * from_mean).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error) for each vector and component, the first ``components`` at most.

    An entry c counts as the whole number x = floor(scale * c) + offset. Components are the eigenvectors of the covariance of
    all vectors, by falling eigenvalue; whitened is what is centred, on the component, over its deviation; explained
    the component's share of the variance; identity_error how far the covariance of whitened is from the identity at most.
    deviation is the exact sum of (n * x - sums)^2, a decimal (null beyond 38 digits).

    Null vectors and those with null or non-finite entries, or entries whose x a long can't hold, are left out, as are
    vectors without entries or of another length than most have. Rows with a null key or a repeated one count like all others. A component
    without variance (equal rows, one row, fewer rows than entries) has null whitened and, if nothing varies, null
    explained; it takes no part in identity_error, null if none does. Without vectors there are no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fit = moments(rows, scale, offset)
    types = "id long, deviation decimal(38,0), v array<double>"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    values, axes = symmetric_qr(fit.covariance)
    values, axes = values[:components], axes[:components]
    trace, floor = float(np.trace(fit.covariance)), max(values[0], 0) * len(fit.mean) * 4 * np.finfo(float).eps
    solid = int((values > floor).sum())
    turn = (axes[:solid] / np.sqrt(values[:solid])[:, None]).T
    n, sums, dims = fit.n, np.array(fit.sums, object), len(fit.mean)
    fits_long = max(abs(s) for s in fit.sums) < 1 << 62

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column("v")):
                if x.shape[1] != dims:
                    continue
                fits, x = _whole(x, scale, offset)
                if fits_long and np.abs(x).max(initial=0) < (1 << 62) // n:
                    apart = n * x - sums.astype(np.int64)
                else:
                    apart = x.astype(object) * n - sums
                found = (apart / n).astype(np.float64) @ turn
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * solid, pa.array(found.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at[fits])), pa.array(_squares(apart), pa.decimal128(38, 0)), flat], ["id", "deviation", "v"])

    projected = stash(rows.mapInArrow(project, types))
    error = None
    if solid:
        error = float(np.abs(moments(projected).covariance - np.eye(solid)).max())
    wanted = F.posexplode(F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])).alias("place", "explained")
    out = projected.select("id", "deviation", "v", wanted)
    return out.select(
        F.col("id").alias(key), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.get("v", F.col("place")).alias("whitened"),
        F.when(F.col("place") < solid, F.col("explained")).otherwise(F.when(F.lit(trace > 0), F.lit(0.0))).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
