"""Whitening of embeddings: centred covariance over all rows, its leading eigenvectors, projection of every row.

Sums are exact (whole numbers); the products of centred rows are added up task by task, and the tasks' matrices, row by row, in
Spark. The matrix, bounded by ``Whitening.most_dims``, then goes to the driver, which brings it to tridiagonal form by
Householder reflections, finds the leading eigenvalues by bisection on Sturm counts and their vectors by inverse iteration,
orthogonalised anew within clusters of close eigenvalues. Components are broadcast: at most ``components`` rows of as many
numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, stored


@dataclass(frozen=True)
class Whitening:
    components: int = 32
    scale: float = 64.0  # components become floor(scale * c) + shift
    shift: int = 1_000_000
    most_dims: int = 4096  # of the matrix on the driver; longer vectors are refused
    cluster: float = 1e-3  # eigenvalues closer than this share of the matrix's norm have their vectors orthogonalised


def tridiagonal(a: np.ndarray):
    """(d, e, reflectors): the diagonals of the tridiagonal matrix Q' a Q; reflector k is a unit vector over rows k+1 on."""
    a = np.array(a, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1:, k]
        v = x.copy()
        size = np.sqrt((x / (top := max(np.abs(x).max(), 1e-300))) @ (x / top)) * top
        v[0] += size if v[0] >= 0 else -size
        norm = np.linalg.norm(v)
        reflectors.append(v / norm if norm > 0 else v * 0)
        v = reflectors[-1]
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        edge = x - 2 * v * (v @ x)
        a[k + 1:, k] = a[k, k + 1:] = edge
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``x``: the sign changes of the Sturm sequence."""
    tiny = np.finfo(float).tiny * max(1.0, np.abs(e).max(initial=0) ** 2)
    q, count = np.full(x.shape, np.inf), np.zeros(x.shape, int)
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to the last bits."""
    n, reach = len(d), np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    wanted = n - np.arange(1, k + 1)  # so many lie below the largest, the next, ...
    for _ in range(128):
        mid = (low + high) / 2
        if ((mid == low) | (mid == high)).all():
            break
        more = below(d, e, mid) <= wanted
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return (low + high) / 2


def solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """x with (T - shift) x = b, by elimination with row exchanges; pivots of nothing count as ``tiny``."""
    n = len(d)
    x = b.astype(float).copy()
    diag, up, far = d - shift, np.append(e, 0.0), np.zeros(n)
    for i in range(n - 1):
        under = e[i]
        if abs(diag[i]) >= abs(under):
            f = under / (diag[i] if diag[i] else tiny)
            diag[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        else:
            f = diag[i] / under
            diag[i], up[i], far[i], diag[i + 1], up[i + 1] = under, diag[i + 1], up[i + 1], up[i] - f * diag[i + 1], -f * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (far[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = rest / (diag[i] if abs(diag[i]) > tiny else tiny)
    return x


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, cluster: float) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix. Those of close eigenvalues are kept orthogonal while they are iterated."""
    n = len(d)
    norm = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    tiny, rng = np.finfo(float).eps * norm, np.random.default_rng(3)
    out, group = np.zeros((len(values), n)), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > cluster * norm:
            group = k
        x = rng.standard_normal(n)
        for _ in range(5):
            x = solved(d, e, value, x / np.linalg.norm(x), tiny)
            for _ in range(2):
                x -= out[group:k].T @ (out[group:k] @ x)
        out[k] = x / np.linalg.norm(x)
    return out


def eigen(a: np.ndarray, k: int, cluster: float = 1e-3):
    """(values, unit vectors as rows) of the ``k`` leading eigenvalues of a symmetric matrix, falling."""
    k = min(k, len(a))
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(k), np.eye(len(a))[:k]
    d, e, reflectors = tridiagonal(a / scale)
    values = leading(d, e, k)
    x = vectors(d, e, values, cluster)
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        x[:, i + 1:] -= 2 * np.outer(x[:, i + 1:] @ v, v)
    return values * scale, x


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column).flatten()
    return np.asarray(values).reshape(batch.num_rows, -1)


def _sums(column: str):
    def make(batches):
        n, total = 0, 0
        for batch in byte_batches(batches):
            x = _matrix(batch, column)
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n] * len(total), "i": range(len(total)), "s": total}, pa.schema([("n", pa.int64()), ("i", pa.int32()), ("s", pa.from_numpy_dtype(total.dtype))]))
    return make


_ROW = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])


def _products(column: str, mean: np.ndarray):
    def make(batches):
        total, any_row = np.zeros((len(mean), len(mean))), False
        for batch in byte_batches(batches):
            x = _matrix(batch, column) - mean
            total += x.T @ x
            any_row = True
        if any_row:
            for i, row in enumerate(total):
                yield pa.RecordBatch.from_pydict({"i": [i], "row": [row]}, _ROW)
    return make


def _added(batches):
    """Rows of equal ``i``, which come one after the other, added up; one is held at a time."""
    i, row = None, None
    for batch in batches:
        for k, r in zip(batch.column("i").to_pylist(), batch.column("row")):
            r = np.asarray(r.values)
            if k == i:
                row = row + r
            else:
                if i is not None:
                    yield pa.RecordBatch.from_pydict({"i": [i], "row": [row]}, _ROW)
                i, row = k, r
    if i is not None:
        yield pa.RecordBatch.from_pydict({"i": [i], "row": [row]}, _ROW)


def sums(rows: DataFrame, column: str, kind: str):
    """(n, sums by dimension) of an array column whose arrays have one length; (0, []) of an empty table."""
    parts = rows.select(column).mapInArrow(_sums(column), f"n long, i int, s {kind}")
    total = sorted((r.i, r.n, r.s) for r in parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    return (total[0][1] if total else 0), [s for _, _, s in total]


def covariance(rows: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of an array column, centred by ``mean`` before anything is multiplied."""
    parts = rows.select(column).mapInArrow(_products(column, mean), "i int, row array<double>")
    added = parts.repartition("i").sortWithinPartitions("i").mapInArrow(_added, "i int, row array<double>")
    out = np.zeros((len(mean), len(mean)))
    for r in added.collect():  # as many rows as dimensions
        out[r.i] = r.row
    return (out + out.T) / 2 / n


_OUT = "id {}, high long, cross long, low long, whitened array<double>"
HALF = 24  # bits: squares of n * x - S are added up in parts that fit a long, and put together as decimals
WIDEST = 1 << 49  # most that n * x - S may be


def _project(total: list, n: int, components: np.ndarray):
    s = np.array(total, np.int64)

    def make(batches):
        for batch in byte_batches(batches):
            x = _matrix(batch, "x")
            if max(abs(int(x.max())), abs(int(x.min())), 1) * n >= 1 << 62 or (off := np.abs(n * x - s)).max() >= WIDEST:
                raise ArithmeticError("whitening: n times a component leaves the range of exact sums")
            a, b = off >> HALF, off & ((1 << HALF) - 1)
            w = ((n * x - s) / n) @ components.T
            flat = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
            parts = [pa.array(p.sum(axis=1)) for p in (a * a, 2 * a * b, b * b)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *parts, flat], ["id", "high", "cross", "low", "whitened"])
    return make


def _exact(high: str, cross: str, low: str):
    whole = lambda c, bits: F.col(c).cast("decimal(20,0)") * F.lit(Decimal(1 << bits))
    return (whole(high, 2 * HALF) + whole(cross, HALF) + whole(low, 0)).cast("decimal(38,0)")


def steps(rows: DataFrame, id_col: str, vector_col: str, how: Whitening) -> DataFrame:
    """id, x (whole numbers) of the rows whose vector is not null or empty and holds no null and no non-finite component."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    x = F.transform("c", lambda v: F.floor(v * how.scale) + F.lit(how.shift))
    return rows.select(F.col(id_col).alias("id"), c.alias("c")).where((F.size("c") > 0) & ~F.exists("c", odd)).select("id", x.alias("x"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", how: Whitening = Whitening()) -> DataFrame:
    """``id_col``, component (from 1), n, deviation, whitened, explained and identity_error, for every row that takes part and component.

    Rows whose vector is null or empty or holds null or non-finite components take no part. Lengths are not padded: the vectors
    of the most frequent length (of equals the longest) take part. Repeated rows count as often, null ids take part. A
    component without variance cannot be scaled to one: eigenvalues at the level of rounding are left out, so fewer
    components come back for flat data, and none if all vectors are equal or the table is empty. ``deviation`` is the exact sum over
    dimensions of (n * x - S) squared, as a decimal; components so large that n * x - S reaches 2^49 are refused.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    x = steps(rows, id_col, vector_col, how)
    lengths = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0].dims if lengths else 0
    if dims > how.most_dims:
        raise ValueError(f"vectors of {dims} components; the matrix on the driver holds {how.most_dims} at most")
    x = x.where(F.size("x") == dims)
    n, total = sums(x, "x", "long")
    names = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], names).withColumnRenamed("id", id_col)
    cov = covariance(x, "x", np.array([s / n for s in total]), n)
    values, parts = eigen(cov, how.components, how.cluster)
    real = values > dims * np.finfo(float).eps * max(np.trace(cov), 0)
    values, parts = values[real], parts[real]
    out = x.mapInArrow(_project(total, n, parts / np.sqrt(values)[:, None]), _OUT.format(kind))
    if not len(values):
        return spark.createDataFrame([], names).withColumnRenamed("id", id_col)
    out = stored(out.select("id", _exact("high", "cross", "low").alias("deviation"), "whitened"), "whitened")
    _, drift = sums(out, "whitened", "double")
    error = float(np.abs(covariance(out, "whitened", np.array(drift) / n, n) - np.eye(len(values))).max())
    share = F.array(*[F.lit(float(v / np.trace(cov))) for v in values])
    out = out.select("id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(share, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"))
