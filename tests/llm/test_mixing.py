import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes):
    """Sources weigh 1, 2, 3, repeating (null last); the excess over three times a source is shared anew until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
    return out


def check(rows, near):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and np.isclose(r.target, want[r.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken == r.copies * r.size)
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 1
        assert r.size == 0 or abs(r.copies - rate) < 1 + 1e-6
    for s, t in want.items():
        assert abs(taken[s] - t) <= near * t + 1e-6, (s, taken[s], t)


def test_query(spark, table):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_mixing"](spark, sf).collect()
    assert all(r.size == len(WORD.findall(texts[r.doc_id])) for r in rows) and len(rows) == len(texts)
    check(rows, 0.02)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op2_mixing"](spark, sf).collect()))


def test_targets_stop_at_three_times_a_source(spark):
    rows = [(k, " ".join(["w"] * n), s) for k, (n, s) in enumerate([(1000, "a"), (7, "b"), (5, "b"), (3, "c"), (40, None), (0, "d"), (2, "é"), (1, "z")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    check(out, 1.0)
    assert {r.copies for r in out if r.source in ("b", "c")} == {3}


def test_awkward_documents(spark, documents):
    out = mixing.mix(documents, keep=("text", "lang", "n_chars")).collect()
    assert len(out) == documents.count()
    assert all(r.size == len(WORD.findall(r.text or "")) for r in out)
    check(out, 1.0)
    assert mixing.mix(documents.limit(0)).count() == 0


def test_hot_sizes_and_sources(spark):
    """A third of all rows are equal; the copies still add up to the target."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text here")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), F.pmod(F.hash("id"), F.lit(50))), lambda i: F.lit("w")), " ")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.pmod("id", F.lit(7)))).alias("source"))
    check(mixing.mix(docs).collect(), 0.005)


def test_two_margins_meet_both_targets(spark):
    rng = np.random.default_rng(3)
    cells = [(s, l, float(rng.integers(50, 500))) for s in ("a", "b", None) for l in ("x", "y")]
    df = spark.createDataFrame(cells, "s string, l string, tokens double")
    total = sum(c[2] for c in cells)
    ts = {"a": .5 * total, "b": .2 * total, None: .3 * total}
    tl = {"x": .35 * total, "y": .65 * total}
    out = mixing.balance(df, {"s": spark.createDataFrame(list(ts.items()), "s string, target double"), "l": spark.createDataFrame(list(tl.items()), "l string, target double")}, near=1e-10).collect()
    for k, t in ts.items():
        assert np.isclose(sum(r.tokens * r.rate for r in out if r.s == k), t, rtol=1e-9)
    for k, t in tl.items():
        assert np.isclose(sum(r.tokens * r.rate for r in out if r.l == k), t, rtol=1e-9)
    rate = {(r.s, r.l): np.log(r.rate) for r in out}  # an exponential tilt: one multiplier for each group
    assert np.isclose(rate["a", "x"] - rate["a", "y"], rate["b", "x"] - rate["b", "y"])


def test_one_margin_takes_one_turn(spark, monkeypatch):
    """Every query of a turn costs the driver memory, so one margin is balanced by one, however far its targets are."""
    names, real = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: names.append(name) or real(df, name))
    tokens = {"a": 10.0, "b": 7.0, None: 100.0, "empty": 0.0, "gone": 5.0, "same": 3.0}
    targets = {"a": 30.0, "b": 7e-4, None: 1e8, "empty": 0.0, "gone": 0.0, "same": 3.0}
    cells = spark.createDataFrame(list(tokens.items()), "s string, tokens double")
    out = mixing.balance(cells, {"s": spark.createDataFrame(list(targets.items()), "s string, target double")}).collect()
    assert len(out) == 6 and names == ["dual"]
    for r in out:
        assert np.isclose(r.tokens * r.rate, targets[r.s], rtol=1e-9, atol=0), r
    assert {r.s: r.rate for r in out if r.s in ("empty", "gone", "same")} == {"empty": 1.0, "gone": 0.0, "same": 1.0}
