"""Whitening of vectors: components of the covariance by FEAST contour integration, verified by inertia counts.

Vectors of floats become whole numbers, floor(scale * c) + offset, so sums and covariances are exact and do not depend on
how rows are dealt to tasks.  Four narrow passes read the vectors: sums per dimension; cross products about the nearest
whole mean (centred before they are multiplied); the covariance of the whitened vectors; the result.  Only sums of as
many numbers as dimensions, or dimensions squared, leave the tasks.

`Spectrum` reduces the covariance to tridiagonal form once and counts eigenvalues above any shift from the signs of the
pivots of T - shift * I (Sylvester's law of inertia).  Bisection by these counts gives an interval that holds the wanted
eigenvalues and ends in a gap of the spectrum.  FEAST projects a block of start vectors onto the interval's eigenspace:
Gauss-Legendre quadrature, along a circle through the interval's ends, of solves (z I - V) Q = Y with complex shifts z.
The solves are independent and run as Spark tasks, one for each node of the contour.  Rayleigh-Ritz on the projected
block gives the eigenpairs; rounds repeat until their residuals are at rounding level.  As many of them as the inertia
counts must lie in the interval; if any is missed, the block grows, up to the whole space.

The matrix of dimensions squared lives on the driver and in each of those tasks (128 MB for 4,096 dimensions).

Defined results: a row whose vector is null, empty, or holds null, non-finite or too large entries (|scale * c| of 2**40
or more) is dropped; vectors of another length than the most frequent one (of equals the greatest) are dropped; null and
repeated ids stay, a row each; components without variance (at rounding level of the largest) are left out, so one
vector, or equal ones, give no rows; a deviation beyond the range of long is null; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.storage import Workspace, small_batches

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
NODES = 8  # of the quadrature on the upper half of the contour
ROUNDS = 30
TOO_LARGE = float(1 << 40)
SLICE = 4096  # rows multiplied at a time


def integers(column: pa.Array, scale: int = SCALE, offset: int = OFFSET, limit: float = TOO_LARGE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole numbers) for each length of the batch's usable vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        scaled = np.floor(scale * flat.reshape(-1, width))
        good = (np.abs(scaled) < limit).all(axis=1)  # false for nan
        if good.any():
            yield at[good], scaled[good].astype(np.int64) + offset


def of_width(column: pa.Array, width: int, **how) -> tuple[np.ndarray, np.ndarray]:
    return next(((at, x) for at, x in integers(column, **how) if x.shape[1] == width), (np.empty(0, np.int64), np.empty((0, width), np.int64)))


@dataclass(frozen=True)
class Moments:
    """n vectors of whole numbers: sums per dimension and their nearest whole means."""

    n: int
    sums: tuple[int, ...]

    @property
    def near(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The means' distances from `near`."""
        return np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.near.tolist(), strict=True)])


def moments(vectors: DataFrame, work: Workspace) -> Moments | None:
    """Exact sums of the vectors (one array column) of the most frequent length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in integers(batch.column(0)):
                width = x.shape[1]
                count[width] = count.get(width, 0) + len(at)
                total[width] = total.get(width, 0) + x.sum(axis=0)
        widths = sorted(count)
        yield pa.record_batch([pa.array(widths, pa.int32()), pa.array([count[w] for w in widths], pa.int64()), pa.array([total[w].tolist() for w in widths], pa.list_(pa.int64()))], names=["width", "n", "sums"])

    table = work.write(vectors.mapInArrow(partial, "width int, n long, sums array<long>"), "sums")
    best = table.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return None
    exact = table.filter(F.col("width") == best["width"]).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return Moments(int(best["n"]), tuple(int(r["s"]) for r in sorted(exact.collect())))


def gathered(rows: DataFrame, work: Workspace, table: str, size: int) -> np.ndarray:
    """The symmetric matrix of (i, array of the entries from i on), added up over all tasks."""
    entries = work.write(rows, table).select("i", F.posexplode("entries").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in entries.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).toLocalIterator():
        values = [e["v"] for e in r["row"]]
        out[r["i"], r["i"] :] = out[r["i"] :, r["i"]] = values
    return out


def _rows_of(m: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.arange(len(m)), pa.int32()), pa.array([m[i, i:].tolist() for i in range(len(m))], pa.list_(pa.float64()))], names=["i", "entries"])


def covariance(vectors: DataFrame, m: Moments, work: Workspace) -> np.ndarray:
    """Divisor n, centred before multiplying: on the nearest whole means, where products are whole and exact as long as they
    have 53 bits, then by the means' rests."""
    near, rest, n = m.near, m.rest, m.n

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(near), len(near)))
        for batch in batches:
            x = of_width(batch.column(0), len(near))[1] - near
            for k in range(0, len(x), SLICE):
                part = x[k : k + SLICE].astype(float)
                total += part.T @ part
        yield _rows_of(total)

    return gathered(vectors.mapInArrow(partial, "i int, entries array<double>"), work, "products", len(near)) / n - np.outer(rest, rest)


class Spectrum:
    """A symmetric matrix in tridiagonal form, for counting its eigenvalues."""

    def __init__(self, v: np.ndarray):
        a = np.array(v, float)
        for k in range(len(a) - 2):  # Householder
            x = a[k + 1 :, k].copy()
            x[0] += math.copysign(np.linalg.norm(x), x[0])
            norm = np.linalg.norm(x)
            if norm == 0:
                continue
            u = x / norm
            p = a[k + 1 :, k + 1 :] @ u
            q = 2 * (p - u * (u @ p))
            a[k + 1 :, k + 1 :] -= np.outer(u, q) + np.outer(q, u)
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
        self.diagonal, self.off = np.diagonal(a).tolist(), np.diagonal(a, 1).tolist()
        reach = np.abs(np.concatenate(([0.0], self.off))) + np.abs(np.concatenate((self.off, [0.0])))
        self.low, self.high = float((self.diagonal - reach).min()), float((self.diagonal + reach).max())
        self.tiny = max(abs(self.low), abs(self.high), 1e-300) * np.finfo(float).eps

    def above(self, shift: float) -> int:
        """Eigenvalues greater than `shift`: the positive pivots of T - shift * I."""
        count, pivot = 0, 1.0
        for a, b in zip(self.diagonal, [0.0, *self.off], strict=True):
            pivot = a - shift - b * b / pivot
            if abs(pivot) < self.tiny * 1e-3:
                pivot = -self.tiny * 1e-3
            count += pivot > 0
        return count

    def bound(self, rank: int) -> float:
        """The rank-th largest eigenvalue to rounding level, by bisection."""
        low, high = self.low - self.tiny, self.high + self.tiny
        while high - low > 4 * self.tiny and low < (mid := (low + high) / 2) < high:
            low, high = (mid, high) if self.above(mid) >= rank else (low, mid)
        return (low + high) / 2

    def interval(self, wanted: int) -> tuple[float, float, int]:
        """(low, high, eigenvalues between them): the `wanted` largest and what can't be told from the last of them.  The
        lower end is the middle of the first clear gap below."""
        size, high = len(self.diagonal), self.high + 8 * self.tiny
        last = self.bound(wanted)
        for rank in range(wanted + 1, size + 1):
            nxt = self.bound(rank)
            if last - nxt > 1e-6 * (high - nxt):
                return (last + nxt) / 2, high, self.above((last + nxt) / 2)
            last = nxt
        low = self.low - max(0.01 * (high - self.low), 8 * self.tiny)
        return low, high, size


def quadrature(low: float, high: float, nodes: int = NODES) -> list[tuple[complex, complex]]:
    """(shift, weight) of the contour's nodes: a circle through both ends, its upper half, as V is real."""
    points, weights = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi / 2 * (1 - points))
    return [(complex(z), complex(w)) for z, w in zip(centre + radius * turn, weights / 2 * radius * turn, strict=True)]


def projected(spark: SparkSession, v: np.ndarray, start: np.ndarray, contour: list[tuple[complex, complex]]) -> np.ndarray:
    """The contour integral of (z I - V)^-1 start; a task for each node solves its shifted system."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shift, weight = contour[k]
                part = (weight * np.linalg.solve(shift * np.eye(len(v)) - v, start.astype(complex))).real
                yield pa.record_batch([pa.array(np.arange(len(v)), pa.int32()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["i", "entries"])

    rows = spark.range(0, len(contour), 1, len(contour)).mapInArrow(solve, "i int, entries array<double>")
    out = np.zeros(start.shape)
    for i, entries in sorted((r["i"], tuple(r["entries"])) for r in rows.collect()):  # nodes x dimensions rows, in one order
        out[i] += entries
    return out


def ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues, falling, and vectors of V within the block's span."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    basis = u[:, s > s[0] * 1e-13] if len(s) and s[0] > 0 else u[:, :0]
    values, turn = np.linalg.eigh(basis.T @ v @ basis)
    return values[::-1], (basis @ turn)[:, ::-1]


def feast(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of the symmetric matrix and their unit vectors (columns), each vector's entry of the
    greatest size positive."""
    size = len(v)
    wanted = min(wanted, size)
    unit = float(np.abs(v).max())
    if unit == 0:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    v = v / unit
    spectrum = Spectrum(v)
    low, high, inside = spectrum.interval(wanted)
    contour, width = quadrature(low, high), min(size, inside + max(4, inside // 2))
    while True:
        block = np.random.default_rng(7).standard_normal((size, width))
        before = math.inf
        for _ in range(ROUNDS):
            values, vectors = ritz(v, projected(spark, v, block, contour))
            within = (values > low) & (values <= high)
            residual = np.abs(v @ vectors[:, within] - vectors[:, within] * values[within]).max(initial=0.0)
            if within.sum() == inside and (residual <= 1e-14 * math.sqrt(size) or residual >= before / 2 and residual <= 1e-11):
                break
            before, block = residual, vectors if vectors.shape[1] else block
        else:
            if width == size:  # the block is the whole space, where Rayleigh-Ritz alone is exact
                values, vectors = ritz(v, np.eye(size))
                within = np.ones(size, bool)
                break
            width = min(size, 2 * width)
            continue
        break
    values, vectors = values[within][:wanted], vectors[:, within][:, :wanted]
    return values * unit, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform.  `error` is the greatest entry of the whitened fit list's covariance minus the identity."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.moments.near).astype(float) - self.moments.rest) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, components: int, work: Workspace) -> Whitening | None:
    """Learn from all rows of one array column; None if no usable vector varies."""
    m = moments(vectors, work)
    v = covariance(vectors, m, work) if m else np.zeros((1, 1))
    if not np.trace(v) > 0:
        return None
    values, basis = feast(work.spark, v, components)
    real = values > len(v) * np.finfo(float).eps * values[0]
    fitted = Whitening(m, values[real], basis[:, real], float(np.trace(v)))
    size, width = int(real.sum()), len(v)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))  # the last row and column are sums
        for batch in batches:
            x = of_width(batch.column(0), width)[1]
            for k in range(0, len(x), SLICE):
                y = fitted.project(x[k : k + SLICE])
                y = np.column_stack((y, np.ones(len(y))))
                total += y.T @ y
        yield _rows_of(total)

    sums = gathered(vectors.mapInArrow(partial, "i int, entries array<double>"), work, "identity", size + 1) / m.n
    error = np.abs(sums[:size, :size] - np.outer(sums[:size, size], sums[:size, size]) - np.eye(size)).max()
    return Whitening(m, fitted.values, fitted.vectors, fitted.trace, float(error))


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Per row, the sum of (n * x - sums)**2, exact; None beyond long."""
    d = x - m.near
    rest = np.array([s - m.n * c for s, c in zip(m.sums, m.near.tolist(), strict=True)], object)
    reach = m.n * int(np.abs(d).max(initial=0)) + m.n
    if x.shape[1] * reach**2 < 1 << 63:
        return (((m.n * d - rest.astype(np.int64)) ** 2).sum(axis=1)).tolist()
    exact = ((m.n * d.astype(object) - rest) ** 2).sum(axis=1).tolist()
    return [e if e < 1 << 63 else None for e in exact]


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", work: Workspace | None = None) -> DataFrame:
    """Fit on all usable vectors of `df` and return, for each of them and each component: vec_id, component (from 1, by
    falling eigenvalue), n, deviation, whitened, explained, identity_error, eigenvalue."""
    small_batches(df.sparkSession)
    work = work or Workspace(df.sparkSession, "whitening")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    model = fit(rows.select("vector"), components, work)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = len(model.values), len(model.moments.sums)
        for batch in batches:
            at, x = of_width(batch.column(1), width)
            many = np.repeat(np.arange(len(at)), k)
            deviation = pa.array(deviations(x, model.moments), pa.int64()).take(pa.array(many))
            each = lambda values: pa.array(np.tile(values, len(at)))
            same = lambda value, kind: pa.array(np.full(len(many), value), kind)
            yield pa.record_batch([
                batch.column(0).take(pa.array(at[many])), each(np.arange(1, k + 1, dtype=np.int32)), same(model.moments.n, pa.int64()), deviation,
                pa.array(model.project(x).ravel()), each(model.values / model.trace), same(model.error, pa.float64()), each(model.values),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return rows.mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
