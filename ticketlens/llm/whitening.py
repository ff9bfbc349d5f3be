"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of the quantised vectors is never formed.  A pass over the
table multiplies a small block Q by it: tasks add up ``X^T (X Q)`` of their
centred rows, Spark adds the tasks' sums, and the driver holds dimensions times
block entries.  Between passes the driver

1. runs Rayleigh-Ritz on the block and takes the residuals |V q - e q|,
2. stops when all wanted residuals are certified against the largest eigenvalue,
3. otherwise filters the block by a Chebyshev polynomial of V (a three-term
   recurrence, one pass a degree) that damps the spectrum below the block's
   smallest Ritz value, and makes it orthonormal by QR.  Where that spectrum
   begins is judged from the trace, which tells the mean of what the block lacks;
   a wrong guess costs passes, not the certificate.

Every pass reads the table anew, so a lost executor costs its tasks only, and
nothing that grows with the rows is kept.  Rows are centred before they are
multiplied: whole numbers by the whole part of their mean exactly, and then by
the fraction that is left.

Rows whose vector is null or holds a null or non-finite entry are left out.
Shorter vectors count as filled up with zero entries.  A null id stays a null.
Components without variance (an eigenvalue of at most ``RANK`` times the
largest, so also tables of a single row) cannot be whitened and are left out; an
empty table gives an empty result.  Entries of over two million in magnitude
are an error.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 31
#: Eigenvalues up to this share of the largest are rounding.
RANK = 1e-11
#: A component is certified when its residual is at most this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Beyond this share a residual that no longer falls is an error.
WORST = 1e-10
DEGREE, ROUNDS = 8, 60
#: Most that a filter may raise the largest eigenvector over the damped ones: beyond it a block loses its other vectors to rounding.
GAIN = 1e10


def usable(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column that take part, their lengths, and floor(1024 c) of their entries."""
    n = pc.list_value_length(col).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(col)), np.maximum(n, 0))
    sound = (n >= 0) & (np.bincount(owner[~np.isfinite(flat)], minlength=len(col)) == 0)
    x = np.floor(SCALE * flat[sound[owner]])
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"an entry of {x[np.abs(x).argmax()] / SCALE} is too large to be quantised")
    rows = np.flatnonzero(sound)
    return rows, n[rows], x.astype(np.int64)


def matrix(n: np.ndarray, flat: np.ndarray, d: int) -> np.ndarray:
    """Entries as rows of d whole numbers, filled up with zeros."""
    if (n == d).all():
        return flat.reshape(len(n), d)
    out = np.zeros((len(n), d), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _vectors(df: DataFrame, vector: str, *others: str) -> DataFrame:
    plain = dict(df.dtypes)[vector] in ("array<float>", "array<double>")
    return df.select(*others, (F.col(vector) if plain else F.col(vector).cast("array<double>")).alias("_v"))


def totals(df: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray]:
    """Number of usable rows and, by dimension, the exact sum of floor(1024 c)."""
    def work(batches):
        for batch in batches:
            _, n, flat = usable(batch.column(0))
            x = matrix(n, flat, int(n.max(initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, x.shape[1], dtype=np.int32)),
                                              pa.array(np.concatenate([[len(n)], x.sum(axis=0)]).astype(np.int64))], names=["i", "s"])
    rows = _vectors(df, vector).mapInArrow(work, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    by = {r.i: r.s for r in rows}
    return by.get(-1, 0), np.array([by[i] for i in range(len(by) - 1)], dtype=object)


class Centre:
    """n rows with sums s: takes the mean off whole numbers, the whole part of it exactly."""

    def __init__(self, n: int, s: np.ndarray):
        self.n, self.s = n, s
        self.whole = np.array([int(v) // n for v in s], np.int64)
        self.rest = np.array([int(v) % n / n for v in s], np.float64)

    def rows(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that take part, their whole numbers, and those less the mean."""
        rows, n, flat = usable(col)
        x = matrix(n, flat, len(self.s))
        return rows, x, (x - self.whole) - self.rest


def covariance_times(df: DataFrame, centre: Centre, q: np.ndarray, vector: str = "embedding") -> tuple[np.ndarray, float]:
    """V q and the trace of V, in one pass; what comes to the driver is of the size of q."""
    d, b = q.shape

    def work(batches):
        total, squares, seen = np.zeros((d, b)), np.zeros(d), False
        for batch in batches:
            _, _, c = centre.rows(batch.column(0))
            total += c.T @ (c @ q)
            squares += (c * c).sum(axis=0)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(squares),
                                              *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(b)]],
                                             names=["i", "t", *[f"y{j}" for j in range(b)]])
    ys = [f"y{j}" for j in range(b)]
    sums = _vectors(df, vector).mapInArrow(work, "i int, t double, " + ", ".join(f"{y} double" for y in ys))
    rows = sums.groupBy("i").agg(F.sum("t").alias("t"), *[F.sum(y).alias(y) for y in ys]).orderBy("i").collect()
    found = np.array([[r[c] for c in ["t", *ys]] for r in rows]) / centre.n
    return found[:, 1:], float(found[:, 0].sum())


def chebyshev(times: Callable[[np.ndarray], np.ndarray], x: np.ndarray, vx: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """A scaled Chebyshev polynomial of V on x: small on [low, cut] against what lies above it.

    vx is V x, so the first degree needs no pass.
    """
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - middle)
    tau = 2 / sigma
    y = (vx - middle * x) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (tau - sigma)
        x, y = y, (times(y) - middle * y) * (2 * new / half) - sigma * new * x
        sigma = new
    return y


def leading(times: Callable[[np.ndarray], np.ndarray], trace: Callable[[], float], d: int, k: int, seed: int = 7, tolerance: float = TOLERANCE,
            degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of a symmetric, non-negative V, unit eigenvectors, and the largest residual's share.

    ``times(q)`` is V q; ``trace()`` is asked after it."""
    b = min(d, max(4 * k, k + 8))
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, b)))[0]
    before = np.inf
    for _ in range(ROUNDS):
        y = times(q)
        small = q.T @ y
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, y = q @ u, y @ u
        if e[0] <= 0:
            return np.zeros(0), np.zeros((d, 0)), 0.0
        residual = float(np.linalg.norm(y - q * e, axis=0)[:k].max() / e[0])
        if residual <= tolerance or residual <= WORST and (b == d or residual > before / 2):
            return e[:k], q[:, :k], residual
        before = residual
        cut = max(e[-1], 1e-14 * e[0])
        mean = min((trace() - e.sum()) / (d - b), 0.95 * cut)
        low = max(0.0, 3 * mean - 2 * cut) if cut > 1e-9 * e[0] else 0.0  # below that the trace is rounding
        t = (2 * e[0] - cut - low) / (cut - low)
        steps = int(np.log(GAIN) / max(np.arccosh(max(t, 1.0)), 1e-3))
        q = np.linalg.qr(chebyshev(times, q, y, low, cut, e[0], max(1, min(degree, steps))))[0]
    raise RuntimeError(f"residual {residual} after {ROUNDS} rounds")


def identity_error(df: DataFrame, centre: Centre, basis: np.ndarray, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity.

    Tasks send count, mean and centred squares; these are joined by means, so
    that nothing is squared before it is centred.
    """
    k = basis.shape[1]

    def work(batches):
        for batch in batches:
            w = centre.rows(batch.column(0))[2] @ basis
            if len(w):
                mean = w.mean(axis=0)
                c = w - mean
                part = np.concatenate([(c.T @ c + len(w) * np.outer(mean, mean)).ravel(), w.sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k, dtype=np.int32)), pa.array(part)], names=["i", "v"])
    rows = _vectors(df, vector).mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    sums = np.array([r.v for r in rows])
    mean = sums[k * k:] / centre.n
    return float(np.abs(sums[:k * k].reshape(k, k) / centre.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """Exact sum over dimensions of (n x - S)^2 for rows of whole numbers; a shift of x changes nothing."""
    far = int(np.abs(x).max(initial=0)) * centre.n + max(abs(int(v)) for v in centre.s)
    if far * far * x.shape[1] < 2 ** 63:
        off = x * centre.n - centre.s.astype(np.int64)
        return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    off = x.astype(object) * centre.n - centre.s
    return pa.array([int(v) for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))


def whiten(df: DataFrame, k: int = 8, vector: str = "embedding", row_id: str = "vec_id", seed: int = 7) -> DataFrame:
    """row_id, component, n, deviation (decimal), whitened, explained and identity_error: a row for each vector and component."""
    n, s = totals(df, vector)
    d = len(s)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark = df.sparkSession
    if not n or not d:
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", row_id)
    centre = Centre(n, s)
    trace = [0.0]

    def times(q: np.ndarray) -> np.ndarray:
        product, trace[0] = covariance_times(df, centre, q, vector)
        return product

    e, q, _ = leading(times, lambda: trace[0], d, min(k, d), seed)
    kept = int((e > RANK * e[0]).sum()) if len(e) else 0
    if not kept:
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", row_id)
    e, q = e[:kept], q[:, :kept]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    basis = q / np.sqrt(e)
    error, share = identity_error(df, centre, basis, vector), e / trace[0]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, x, c = centre.rows(batch.column(1))
            if not len(rows):
                continue
            m = len(rows)
            w = c @ basis
            apart = deviations(x, centre)
            at = np.repeat(np.arange(m), kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[at])), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * kept, n)), apart.take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(share, m)),
                 pa.array(np.full(m * kept, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    out = _vectors(df, vector, F.col(row_id).cast("long").alias("vec_id")).select("vec_id", "_v").mapInArrow(work, schema)
    return out.withColumnRenamed("vec_id", row_id)
