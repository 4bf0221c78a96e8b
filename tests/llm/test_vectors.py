"""Near-duplicate embeddings, exact search and connected components against brute force."""

import math

import numpy as np
import pytest

from tessera.llm import knn, near_embeddings
from tessera.llm.components import components
from tessera.llm.queries import QUERIES

KIND = "vec_id long, embedding array<float>, label int, rep string, n string, id string, g string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c", "c") for r in rows], KIND)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def padded(v, d):
    return np.array(list(v) + [0.0] * (d - len(v)), dtype=np.float64)


def brute(rows, t=0.98):
    d = max((len(r[1]) for r in rows if r[1]), default=1)
    good = [usable(r[1]) and any(r[1]) and r[2] is not None and r[0] is not None for r in rows]
    x = np.array([padded(np.float32(r[1]), d) if g else np.zeros(d) for r, g in zip(rows, good)])
    n = np.sqrt((x * x).sum(1))
    linked = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        if good[i]:
            with np.errstate(invalid="ignore", divide="ignore"):
                c = x @ x[i] / (n * n[i])
            linked[i] = [good[j] and j != i and rows[j][2] == rows[i][2] and c[j] >= t for j in range(len(rows))]
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in np.flatnonzero(linked[i]):
                if comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return sorted((str(r[0]), int(linked[i].sum()), str(comp[i])) for i, r in enumerate(rows))


def result(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in df.collect())


def vectors(seed, n, d=16):
    """Clusters whose members lie about the threshold from each other, of three labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            x = base / np.linalg.norm(base) + rng.normal(size=d) * rng.choice([0.0, 0.02, 0.05, 0.06]) / math.sqrt(d) * 4
        else:
            x = rng.normal(size=d)
        rows.append((k * 7 % (7 * n), [float(v) for v in np.float32(x * rng.uniform(0.1, 9))], int(rng.integers(3))))
    return rows


AWKWARD = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None),
           (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0, 0.0], 1), (11, [1.0, 2.0], 2), (8, [1.0, 2.0], 1), (12, [-1.0, -2.0], 1), (13, [1e-38, 2e-38], 1), (14, [3e38, 3e38], 1)]


def test_near_duplicates_of_awkward_vectors(spark):
    assert result(near_embeddings.near_duplicates(frame(spark, AWKWARD))) == brute(AWKWARD)
    lost = near_embeddings.near_duplicates(frame(spark, AWKWARD[:7])).collect()
    assert len(lost) == 7 and all(r.n_links == 0 and r.kept for r in lost)
    assert near_embeddings.near_duplicates(frame(spark, AWKWARD).limit(0)).count() == 0


@pytest.mark.parametrize("grid", [near_embeddings.Grid(block=4, dims=2, chunk=16), near_embeddings.Grid(block=5, dims=3, width=2.5, chunk=1024)])
def test_near_duplicates_equal_brute_force(spark, grid):
    rows = vectors(5, 260)
    assert sum(n for _, n, _ in brute(rows)) > 100
    assert result(near_embeddings.near_duplicates(frame(spark, rows), grid=grid)) == brute(rows)


def test_near_duplicates_query(spark, sf, table):
    rows = [(r.vec_id, r.embedding, r.label) for r in table("embeddings").collect()]
    assert result(QUERIES["op1_near_embeddings"](spark, sf)) == brute(rows)


def best(rows, asks, k=5):
    own = [(r[0], [max(-2 ** 63, min(2 ** 63 - 1, math.floor(256.0 * float(np.float32(x))))) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and (usable(r[1]) or r[1] == [])]
    own = list({(i, tuple(v)): (i, v) for i, v in own}.values())
    out = []
    for q in sorted({i for i, _ in own if i % asks == 0}):
        scores = {}
        for i, v in own:
            for j, w in own:
                if i == q and j != q:
                    scores.setdefault((j, tuple(w)), []).append(max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))))
        order = sorted(((-s, j) for (j, _), ss in scores.items() for s in ss))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(order)]
    return out


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("cells", [knn.Cells(), knn.Cells(pivots=5, sample=30, data_chunk=20, query_chunk=3), knn.Cells(pivots=1)])
def test_search_equals_brute_force(spark, cells):
    from pyspark.sql import functions as F
    rows = vectors(9, 150, d=6)
    rows += [(10_000 + k, rows[0][1], 1) for k in range(8)]  # ties
    rows += rows[:5]  # repeated rows count once
    assert found(knn.search(frame(spark, rows), F.col("vec_id") % 10 == 0, cells=cells)) == best(rows, 10)


def test_search_of_awkward_vectors(spark):
    from pyspark.sql import functions as F
    rows = [r for r in AWKWARD if not (r[1] and r[1] == [3e38, 3e38])]
    assert found(knn.search(frame(spark, rows), F.col("vec_id") % 2 == 0)) == best(rows, 2)
    big = [(0, [3e38, 1.0], 1), (1, [3e38, -1.0], 1), (2, [-3e38, 2.0], 1), (3, [1e9, 0.5], 1), (4, [1.0, 1e9], 1)]
    assert found(knn.search(frame(spark, big), F.col("vec_id") % 2 == 0)) == best(big, 2)
    assert found(knn.search(frame(spark, rows[:1]), F.col("vec_id") % 2 == 0)) == []
    assert found(knn.search(frame(spark, [(0, [1.0], 1)]), F.col("vec_id") % 2 == 0)) == []
    assert knn.search(frame(spark, rows).limit(0), F.col("vec_id") % 2 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_search_query(spark, sf, table):
    rows = [(r.vec_id, r.embedding, r.label) for r in table("embeddings").collect()]
    assert found(QUERIES["op3_topk_search"](spark, sf)) == best(rows, 50)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(300)], [(0, k) for k in range(1, 200)], [(500, k) for k in range(200)],
                                   [(int(a), int(b)) for a, b in np.random.default_rng(2).integers(0, 400, (260, 2))], [(1, 2), (2, 1), (1, 2), (None, 3)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert got == {x: root(x) for x in list(parent)}


def test_queries_equal_their_sql(spark, duck, sf):
    from tessera.llm.queries import ORACLE
    for name, columns in (("op1_near_embeddings", ["vec_id", "n_links", "component_id", "kept"]), ("op3_topk_search", ["query_id", "rank", "vec_id", "score"]),
                          ("op8_chat_formatting", ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])):
        got = sorted(tuple(r) for r in QUERIES[name](spark, sf).select(columns).collect())
        assert got == sorted(duck.execute(ORACLE[name]).fetchall()), name
