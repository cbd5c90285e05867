"""Embedding whitening: principal components by a symmetric eigensolver, rows projected by a broadcast.

A vector's entries c become whole numbers x = floor(1024 * c) + 100000. Spark sums them exactly (count and sum per
dimension), then the covariance of the centred numbers, partition by partition. The driver has that matrix alone, whose
size is the square of the dimension: Householder reflections make it tridiagonal, bisection with Sturm counts gives
the leading eigenvalues, inverse iteration their vectors, reorthogonalised within clusters of near eigenvalues,
and the reflections turn them back. The components are broadcast and every vector is projected.

Dropped: null vectors, vectors with a null or non-finite entry, or one of 2**42 and more (its x would not stay exact in
sums of longs), vectors without entries, and vectors of another than the commonest length (of several, the greatest); all other
rows count, repeated ones each, null ids too. The length is at most ``MAX_DIM``; a longer one is an error, as
its matrix would not fit the driver. Components without variance (e <= length * 2**-52 * trace) can't be scaled and are left out, so equal vectors,
a single one or an empty table give no rows. ``deviation`` is null where it exceeds a long; ``deviation_exact`` has 38 digits and always the value.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import quoted

SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**42
MAX_DIM = 2048
#: partial sums of so many partitions are added in a first step
FAN_IN = 256
#: entries that are handled at once
ENTRIES = 1 << 20
_EPS = 2.0**-52
#: eigenvalues closer than this part of the norm are a cluster
CLUSTER = 1e-3
SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
)


# --- the eigensolver ---------------------------------------------------------------
def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal, and the Householder vectors (unit, or zero) that make the symmetric matrix tridiagonal."""
    a = np.array(matrix, dtype=np.float64)
    vectors = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        top = -np.copysign(np.linalg.norm(v), v[0])
        below = np.abs(v[1:]).max() > 0
        if below:
            v[0] -= top
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = top
        vectors.append(v if below else np.zeros_like(v))
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), vectors


def smaller(d: np.ndarray, e: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are below each number."""
    count, q = np.zeros(len(at), np.int64), 1.0
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, by bisection down to neighbouring numbers."""
    reach = np.concatenate(([0.0], np.abs(e))) + np.concatenate((np.abs(e), [0.0]))
    norm = max(np.abs(d).max() + reach.max(), np.finfo(float).tiny)
    least = np.finfo(float).tiny / _EPS + _EPS**2 * norm
    rank = len(d) - 1 - np.arange(k)  # of each, from the least
    lo, hi = np.full(k, (d - reach).min() - 4 * _EPS * norm), np.full(k, (d + reach).max() + 4 * _EPS * norm)
    while True:
        mid = lo + (hi - lo) / 2
        open_ = (mid > lo) & (mid < hi) & (hi - lo > _EPS * np.maximum(np.abs(lo), np.abs(hi)) + least)
        if not open_.any():
            return mid
        above = smaller(d, e, mid, least) > rank
        hi = np.where(open_ & above, mid, hi)
        lo = np.where(open_ & ~above, mid, lo)


class _Shifted:
    """The tridiagonal matrix less ``shift`` times the identity, factored with row exchanges."""

    def __init__(self, d: np.ndarray, e: np.ndarray, shift: float, least: float) -> None:
        n = len(d)
        u0, u1, u2 = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n
        low, swap, factor = e.tolist(), [False] * n, [0.0] * n
        for i in range(n - 1):
            if abs(low[i]) > abs(u0[i]):
                swap[i] = True
                factor[i] = u0[i] / low[i]
                u0[i], nxt, over = low[i], u1[i], u0[i + 1]
                u1[i], u2[i] = over, u1[i + 1]
                u0[i + 1], u1[i + 1] = nxt - factor[i] * over, -factor[i] * u2[i]
            else:
                if abs(u0[i]) < least:
                    u0[i] = least
                factor[i] = low[i] / u0[i]
                u0[i + 1] -= factor[i] * u1[i]
        if abs(u0[-1]) < least:
            u0[-1] = least
        self.u0, self.u1, self.u2, self.swap, self.factor = u0, u1, u2, swap, factor

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, n = b.tolist(), len(b)
        for i in range(n - 1):
            if self.swap[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - self.factor[i] * y[i + 1]
            else:
                y[i + 1] -= self.factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            more = self.u1[i] * y[i + 1] if i + 1 < n else 0.0
            more += self.u2[i] * y[i + 2] if i + 2 < n else 0.0
            y[i] = (y[i] - more) / self.u0[i]
        return np.array(y)


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues, by inverse iteration."""
    norm = max(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    rng = np.random.default_rng(20)
    out = np.zeros((len(d), len(values)))
    cluster, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        shift = min(value, shift - 4 * _EPS * norm)  # equal eigenvalues get shifts that differ
        system = _Shifted(d, e, shift, _EPS * norm)
        near = out[:, cluster:j]
        y = rng.standard_normal(len(d))
        for _ in range(5):
            y = system.solve(y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):
                y -= near @ (near.T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors (columns); of a vector and its
    negative, the one whose greatest entry is positive."""
    if not np.any(matrix):
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    scale = 2.0 ** np.floor(np.log2(np.abs(matrix).max()))  # squares neither overflow nor vanish
    d, e, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(d, e, k)
    z = tridiagonal_vectors(d, e, values)
    for at in range(len(reflections) - 1, -1, -1):
        v = reflections[at]
        z[at + 1 :] -= 2 * np.outer(v, v @ z[at + 1 :])
    z /= np.linalg.norm(z, axis=0)
    return values * scale, z * np.sign(z[np.abs(z).argmax(axis=0), np.arange(k)])


# --- the sums, in Spark ------------------------------------------------------------
def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, c) of the rows that count, and their length (0: there are none)."""
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<double>").alias("c"))
    finite = F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < LIMIT))  # not so for NaN, which is greater than any number
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.coalesce(finite, F.lit(False)))
    best = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if best is None:
        return rows, 0
    if best["d"] > MAX_DIM:
        raise ValueError(f"vectors of {best['d']} entries: the matrix of {MAX_DIM} by {MAX_DIM} is the greatest that the driver takes")
    return rows.where(F.size("c") == best["d"]), best["d"]


def numbers(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array | None, np.ndarray]]:
    """(ids, the numbers x) of some vectors at a time; a batch has the vectors last, and before them the ids or nothing."""
    step = max(1, ENTRIES // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            c = np.asarray(some.column(some.num_columns - 1).flatten()).reshape(-1, d)
            yield (some.column(0) if some.num_columns > 1 else None), np.floor(c * SCALE).astype(np.int64) + SHIFT


def summed(partials: DataFrame, d: int) -> np.ndarray:
    """Rows (salt, i, part) added up by i: the driver gets as many rows as there are i, each an array of ``d`` numbers.

    The parts of ``FAN_IN`` partitions are added first, so no group grows with the partitions' number squared or the data."""

    def add(table: pa.Table) -> pa.Table:
        parts = np.asarray(table.column("part").combine_chunks().flatten()).reshape(-1, d)
        total = pa.FixedSizeListArray.from_arrays(pa.array(parts.sum(axis=0)), d).cast(pa.list_(pa.float64()))
        return pa.table({"salt": table.column("salt").slice(0, 1), "i": table.column("i").slice(0, 1), "part": total})

    schema = "salt int, i int, part array<double>"
    first = partials.groupBy("salt", "i").applyInArrow(add, schema).withColumn("salt", F.lit(0))
    rows = first.groupBy("i").applyInArrow(add, schema).select("i", "part").toArrow()
    order = np.argsort(rows.column("i").to_numpy())
    return np.asarray(rows.column("part").combine_chunks().flatten()).reshape(-1, d)[order]


def _parts(total: np.ndarray) -> pa.RecordBatch:
    """A matrix as rows (salt, i, part)."""
    salt = TaskContext.get().partitionId() // FAN_IN
    part = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
    k = len(total)
    return pa.RecordBatch.from_arrays([pa.array([salt] * k, pa.int32()), pa.array(range(k), pa.int32()), part], names=["salt", "i", "part"])


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of vectors, the sum of x in each dimension, and the greatest distance of two x of one dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        least, most = np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for _, x in numbers(batches, d):
            n += len(x)
            high += (x >> 20).sum(axis=0)  # two parts, whose sums stay far below 2**63
            low += (x & 0xFFFFF).sum(axis=0)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            cols = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), *(pa.array(v) for v in (high, low, least, most))]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "n", "high", "low", "least", "most"])

    parts = rows.select("c").mapInArrow(each, "i int, n long, high long, low long, least long, most long")
    found = parts.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"),
        (F.max("most") - F.min("least")).alias("range"),
    ).orderBy("i").collect()
    return found[0]["n"], [(int(r["high"]) << 20) + int(r["low"]) for r in found], max(r["range"] for r in found)


def covariance(rows: DataFrame, mean: np.ndarray, n: int, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor ``n``) of the centred numbers, or of their projections."""
    d, k = len(mean), len(mean) if project is None else project.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in numbers(batches, d):
            z = x - mean
            z = z if project is None else z @ project
            total += z.T @ z
        yield _parts(total)

    return summed(rows.select("c").mapInArrow(each, "salt int, i int, part array<double>"), k) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray, width: int) -> tuple[pa.Array, pa.Array]:
    """Sum of (n*x - S)**2 over the dimensions, as long (null where it exceeds one) and as decimal."""
    if x.shape[1] * (n * width) ** 2 < 2**63 and n * (int(np.abs(x).max()) + 1) < 2**63:
        exact = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)
        return pa.array(exact), pa.array(exact).cast(pa.decimal128(38, 0))
    values = ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
    return pa.array([v if v < 2**63 else None for v in values], pa.int64()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component, numbered from 1: vec_id, component, n, deviation, whitened (its
    projection over the root of the eigenvalue), explained (eigenvalue over trace), identity_error (greatest distance of the
    whitened rows' covariance from the identity, measured over all of them), deviation_exact."""
    rows, d = usable(vectors, id_col, vector_col)
    nothing = vectors.sparkSession.createDataFrame([], SCHEMA)
    if d == 0:
        return nothing
    n, sums, width = exact_sums(rows, d)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    v = covariance(rows, mean, n)
    values, vecs = leading_components(v, min(components, d))
    trace = float(np.trace(v))
    k = int((values > d * _EPS * trace).sum())
    if k == 0:
        return nothing
    project = vecs[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(covariance(rows, mean, n, project) - np.eye(k)).max())
    shared = vectors.sparkSession.sparkContext.broadcast((mean, project, np.array(sums, dtype=object), values[:k] / trace))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, project, sums, explained = shared.value
        for ids, x in numbers(batches, d):
            of = pa.array(np.repeat(np.arange(len(x)), k))
            deviation, exact = deviations(x, n, sums, width)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(of), n)),
                    deviation.take(of), pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(of), error)), exact.take(of),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return rows.mapInArrow(each, SCHEMA)
