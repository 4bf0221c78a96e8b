import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening as W
from tessera.llm.queries import QUERIES


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1.0, 41), np.ones(12), np.r_[np.full(6, 5.0), np.full(6, 5.0 - 1e-13), 1, 0, 0], np.array([7.0]), np.array([3.0, -2.0]), np.zeros(5),
    1e12 * np.arange(1.0, 9), 1e-12 * np.arange(1.0, 9), np.r_[1e6, np.linspace(1, 2, 30)], np.linspace(1, 1 + 1e-9, 50)])
def test_eigenvectors(values):
    a = symmetric(values)
    k = min(8, len(values))
    got, x = W.eigen(a, k)
    scale = max(1e-300, np.abs(values).max())
    assert np.abs(got - np.sort(values)[::-1][:k]).max() <= 1e-12 * scale
    assert np.abs(x @ x.T - np.eye(k)).max() < 1e-10
    assert np.abs(a @ x.T - x.T * got).max() <= 1e-11 * scale


def test_tridiagonal_form_keeps_the_spectrum_and_sturm_counts_it():
    a = symmetric(np.arange(1.0, 11))
    d, e, _ = W.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.allclose(np.linalg.eigvalsh(t), np.arange(1.0, 11))
    assert W.below(d, e, np.array([0.5, 3.5, 10.5])).tolist() == [0, 3, 10]
    assert W.below(np.array([1.0, 1.0, 5.0]), np.zeros(2), np.array([1.0 + 1e-9, 4.0])).tolist() == [2, 2]


def check(rows, got, components=32):
    """``rows``: (id, vector); ``got``: result rows, against numpy and whole numbers."""
    good = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    centred = (off / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = min(components, int((values > len(values) * 2e-16 * max(values.sum(), 0)).sum()))
    by = defaultdict(list)
    for r in got:
        by[r[0], int(r.deviation)].append(r)
    assert len(got) == n * k
    assert sorted(map(repr, ((i, int((o * o).sum())) for (i, _), o in zip(good, off)))) == sorted(repr((i, d)) for (i, d), g in by.items() for _ in range(len(g) // max(k, 1)))
    assert all(r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 * r.explained + 1e-14 and r.identity_error < 1e-6 for r in got)
    return centred, values, vectors, k


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op13_whitening"](spark, sf).collect()
    centred, values, vectors, k = check(rows, got)
    assert k == 32
    w = {(r.vec_id, r.component): r.whitened for r in got}
    table = np.array([[w[i, c + 1] for c in range(k)] for i, _ in rows])
    want = centred @ vectors[:k].T / np.sqrt(values[:k])
    sign = np.sign((table * want).sum(axis=0))
    apart = np.diff(values[:k + 1]) < -1e-6 * values[0]
    assert np.abs(table * sign - want)[:, apart].max() < 1e-6


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("clash") for c in ("id", "x", "c", "n", "component", "whitened", "i", "row")}).repartition(4)


def test_awkward_rows(spark):
    r = np.random.default_rng(2)
    rows = [(k, r.standard_normal(6).tolist()) for k in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, []), (1, rows[1][1]), (None, rows[2][1])]
    check(rows, W.whiten(frame(spark, rows)).collect())
    stray = rows + [(200, [1.0] * 9), (201, [1.0])]
    assert {r.vec_id for r in W.whiten(frame(spark, stray)).collect()} == {r.vec_id for r in W.whiten(frame(spark, rows)).collect()}


def test_flat_and_empty_tables(spark):
    flat = [(k, [1.0, float(k), 2.0 * k]) for k in range(9)]  # one direction of variance
    got = W.whiten(frame(spark, flat)).collect()
    check(flat, got)
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert W.whiten(frame(spark, [(1, None)])).collect() == []
    assert W.whiten(frame(spark, []).where("vec_id = 0")).columns[0] == "vec_id"


def test_refusals(spark):
    with pytest.raises(ValueError):
        W.whiten(frame(spark, [(1, [1.0] * 5)]), how=W.Whitening(most_dims=4))


def test_large_deviations_are_exact(spark):
    rows = [(k, [float(k % 2) * 2 ** 33, float(k)]) for k in range(20)]
    check(rows, W.whiten(frame(spark, rows)).collect())
    with pytest.raises(Exception, match="range of exact sums"):
        W.whiten(frame(spark, [(k, [float(k) * 2 ** 45]) for k in range(3)])).collect()
