"""Whitening of embeddings.

Every partition streams its vectors through Welford's rank-one update; the
partitions' counts, exact sums and co-moments meet in small groups by the
parallel update formula, level by level, until one state is left.  Its
covariance goes through a symmetric QR solver (Householder reflections to
three diagonals, then implicit steps with Wilkinson's shift), and the leading
components project the vectors in one more pass.

Entries become integers first, floor(1024 c) + 100000, so that sums are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.llm.scratch import discard, mapped, materialize, own

#: Components; entries become floor(SCALE * c) + SHIFT; states that meet in one task.
COMPONENTS, SCALE, SHIFT, FAN_IN = 8, 1024, 100_000, 64
#: Larger entries count as this large: beyond it a batch's sums could pass 64 bits.
LARGEST = float(1 << 40)
#: Components whose eigenvalue is a smaller part of the largest one have no direction of their own.
RANK = 1e-11


class Moments:
    """Count, sums and co-moments about the mean of the vectors seen."""

    def __init__(self, dims: int):
        self.n, self.mean, self.co = 0, np.zeros(dims), np.zeros((dims, dims))
        self.sums = [0] * dims
        self._one = np.zeros((dims, dims))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update with each row; sums of integer rows stay exact."""
        for x in rows.astype(np.float64):
            self.n += 1
            step = x - self.mean
            self.mean += step / self.n
            step *= np.sqrt((self.n - 1) / self.n)
            np.multiply(step[:, None], step, out=self._one)
            self.co += self._one
        if rows.dtype == np.int64:
            self.sums = [s + int(x) for s, x in zip(self.sums, rows.sum(0), strict=True)]
            if self.n:
                self.mean = np.array([s / self.n for s in self.sums])

    def merge(self, other: Moments) -> None:
        """The parallel form of the update."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.co += other.co + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    @property
    def covariance(self) -> np.ndarray:
        return self.co / max(self.n, 1)

    def packed(self) -> bytes:
        return pickle.dumps((self.n, self.mean, self.co, self.sums))

    @classmethod
    def unpacked(cls, state: bytes) -> Moments:
        n, mean, co, sums = pickle.loads(state)
        out = cls(len(mean))
        out.n, out.mean, out.co, out.sums = n, mean, co, sums
        return out


def _states(frame: DataFrame, run) -> Moments | None:
    """All partitions' states in one; at most ``FAN_IN`` meet in a task, and one row reaches the driver."""
    table, path = materialize(mapped(frame, run, "state binary"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in b.column("state"):
                one = Moments.unpacked(s.as_py())
                if total is None:
                    total = one
                else:
                    total.merge(one)
        if total is not None:
            yield _state(total)

    left = table.count()
    while left > 1:
        left = -(-left // FAN_IN)
        table = mapped(table.repartition(left), meet, "state binary")
    row = table.first()
    discard(frame.sparkSession, path)
    return Moments.unpacked(row["state"]) if row else None


def _state(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.packed()], pa.binary())], names=["state"])


# ---------------------------------------------------------------- eigenvectors


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, next diagonal, q) with a = q' T q, by Householder reflections; ``q`` holds its vectors as rows."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    size = np.abs(a).max(initial=0.0)
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    top, eps = len(d) - 1, np.finfo(float).eps
    while top > 0:
        e[np.abs(e) <= eps * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[top - 1] == 0:
            top -= 1
            continue
        low = top - 1
        while low and e[low - 1] != 0:
            low -= 1
        half = (d[top - 1] - d[top]) / 2
        x, z = d[low] - (d[top] - e[top - 1] ** 2 / (half + np.copysign(np.hypot(half, e[top - 1]), half))), e[low]
        for k in range(low, top):  # the bulge runs down the diagonals
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < top - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order] * size, q[order]


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: count, exact sums, components (rows) with their eigenvalues, trace of the covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Rows about the mean, and each row's exact sum of (n x - S)^2; None where that passes 64 bits."""
        large = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if large < 1 << 62:
            t = self.n * x - np.array(self.sums, dtype=np.int64)
            if int(np.abs(t).max(initial=0)) ** 2 * max(x.shape[1], 1) < 1 << 62:
                return t / self.n, (t * t).sum(1).tolist()
        t = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        exact = [int(s) for s in (t * t).sum(1)]
        return (t / self.n).astype(np.float64), [s if s < 1 << 63 else None for s in exact]

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y @ self.axes.T) / np.sqrt(self.values)


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, their entries as integers)."""
    fits = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims
    c = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null entry reads as NaN
    fine = np.isfinite(c).all(1)
    return np.flatnonzero(fits)[fine], np.clip(np.floor(SCALE * c[fine]), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _rows(vectors: DataFrame) -> DataFrame:
    return own(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))


def _length(rows: DataFrame) -> int:
    most = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most["d"] if most else 0


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of all vectors that take part; None where there are none."""
    rows = _rows(vectors)
    dims = _length(rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(dims)
        for b in batches:
            m.add(integers(b.column("embedding"), dims)[1])
        if m.n:
            yield _state(m)

    m = _states(rows.select("embedding"), gather) if dims else None
    if m is None:
        return None
    values, axes = symmetric_qr(m.covariance)
    kept = min(components, int((values > RANK * values[0]).sum()) if values[0] > 0 else 0)
    return Whitening(m.n, m.sums, axes[:kept], values[:kept], float(np.trace(m.covariance)))


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (array<double>) of every vector that takes part."""
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = integers(b.column("embedding"), dims)
            y, far = model.centred(x)
            flat = pa.array(model.project(y).ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(model.values))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(far, pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["vec_id", "deviation", "whitened"])

    return mapped(_rows(vectors), run, "vec_id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over all rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(components)
        for b in batches:
            m.add(b.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components))
        if m.n:
            yield _state(m)

    m = _states(white.select("whitened"), gather)
    return float(np.abs(m.covariance - np.eye(components)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component.

    A vector that is null or holds a null or non-finite entry takes no part, nor
    does one of another length than most vectors have (ties: the shorter
    length; empty ones never count).  Repeated rows and null ids count as any
    row; other columns are dropped.  Components without variance are left out,
    so equal vectors, one vector or an empty table give no rows.  Entries past
    2^30 count as that large; ``deviation`` is null where it passes 64 bits.
    """
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return own(vectors, "vec_id").where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in _REPORT])
    white = apply(vectors, model)
    error = identity_error(white, len(model.values))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    out: dict[str, Column] = {"component": F.col("at") + 1, "n": F.lit(model.n), "deviation": F.col("deviation"), "whitened": F.col("whitened"), "explained": F.get(share, F.col("at")), "identity_error": F.lit(error)}
    return long.select("vec_id", *[out[c].cast(t).alias(c) for c, t in _REPORT])


_REPORT = [("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
