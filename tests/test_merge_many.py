"""Merges of many inputs at once against a left fold in plain Python; crowded and null keys."""

import contextlib
import io
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators.aggregate import value_counts_top
from tessera.operators.combine import merge_frames
from tessera.operators.heavy import most_frequent, summaries
from tessera.operators.merge import crowded_keys, merge_many, _tagged

SF = "/root/testdata/sf0.001"


def fold(tables, how):
    """Rows (key, v1, v2, ...) of a left fold; ``tables``: lists of (key, value)."""
    acc = [(k, (v,)) for k, v in tables[0]]
    for i, t in enumerate(tables[1:], 1):
        right, left = defaultdict(list), defaultdict(list)
        for k, v in t:
            right[k].append(v)
        for k, vs in acc:
            left[k].append(vs)
        keys = {"inner": left.keys() & right.keys(), "left": left.keys(), "right": right.keys(), "outer": left.keys() | right.keys()}[how]
        acc = [(k, vs + (v,)) for k in keys for vs in left.get(k, [(None,) * i]) for v in right.get(k, [None])]
    return Counter((k, *vs) for k, vs in acc)


def tables(seed, n, rows, hot=0):
    r = random.Random(seed)
    out = [[(r.choice([None, *range(12)]), f"{i}.{j}" if j % 5 else None) for j in range(rows)] for i in range(n)]
    for t in out[: 2]:
        t += [(None, f"hot{j}") for j in range(hot)]
    return out


def frames(spark, data):
    return [spark.createDataFrame(t, f"k long, v{'' if i < 2 else i} string") for i, t in enumerate(data)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("n,rows,hot,crowd", [(2, 9, 0, 10_000), (4, 9, 0, 10_000), (3, 14, 40, 7), (4, 10, 12, 3), (2, 0, 0, 5)])
def test_equals_a_left_fold(spark, how, n, rows, hot, crowd):
    data = tables(n * 31 + rows, n, rows, hot)
    got = merge_many(frames(spark, data), ["k"], how, crowd=crowd)
    assert got.columns == ["k", "v", "v_2", *[f"v{i}" for i in range(2, n)]]
    assert Counter(map(tuple, got.collect())) == fold(data, how)


def test_same_as_step_by_step_joins_on_two_keys(spark):
    r = random.Random(3)
    kinds = ["a string, b long, x long", "b long, x double, a string", "a string, b int"]
    fs = [spark.createDataFrame([tuple({"a": r.choice(["p", "q", None]), "b": r.choice([1, 2, None]), "x": 1.0 * j if "double" in k else j}[c.split()[0]] for c in k.split(", "))
                                 for j in range(12)], k) for k in kinds]
    for how in ("inner", "left", "right", "outer"):
        a, b = merge_many(fs, ["a", "b"], how), merge_frames(fs, ["a", "b"], how)
        assert a.columns == b.columns and Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_refusals(spark):
    f = frames(spark, tables(1, 2, 3))
    for bad in (lambda: merge_many(f, []), lambda: merge_many(f, ["k"], "semi"), lambda: merge_many(f, ["nope"])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_one_exchange_for_six_inputs(spark, how):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        entry.queries()[f"merge_six_{how}"](spark, SF).explain("formatted")
    plan = out.getvalue()
    tree = plan[: plan.index("(1) ")]
    # two of the inputs are sums of their own, with an exchange each
    assert tree.count("Exchange") == 1 + 2 and "Join" not in tree and tree.count("Scan parquet") == 6


def test_a_crowded_null_key_is_spread(spark):
    """A third of the rows of two inputs on the null key: no group of the exchange holds more than a chunk a side."""
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    left = li.select(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey")).alias("k"), F.col("l_linenumber").alias("a"))
    right = li.where("l_linenumber = 1").select(F.when(F.col("l_orderkey") % 300 != 0, F.col("l_orderkey")).alias("k"), F.col("l_partkey").alias("b"))
    heavy = crowded_keys(_tagged([left, right], ["k"]), ["k"], 2, "outer", 500)
    [row] = heavy.collect()
    nulls = [f.where("k IS NULL").count() for f in (left, right)]
    assert row.k is None and row["__chunks"] == [-(-c // 500) for c in nulls] and nulls[0] > li.count() / 4
    out = merge_many([left, right], ["k"], "outer", crowd=500)
    assert out.where("k IS NULL").count() == nulls[0] * nulls[1]
    want = merge_frames([left.where("k IS NOT NULL"), right.where("k IS NOT NULL")], ["k"], "outer")
    got = out.where("k IS NOT NULL")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    sizes = [r.n for r in out.where("k IS NULL").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("counters", [2, 5, 40, 10_000])
def test_summaries_bound_counts_and_lead_to_the_same_top(spark, counters):
    r = random.Random(counters)
    values = [r.choice(["a"] * 9 + ["b"] * 5 + ["c", None] + [f"r{i}" for i in range(30)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    true = Counter(v for v in values if v is not None)
    found, off = summaries(df, F.col("v"), counters)
    low = {x.value: x.low for x in found.collect()}
    assert all(low.get(v, 0) <= c <= low.get(v, 0) + off for v, c in true.items())
    for k in (1, 2, 7, 100):
        top = [(x["v"], x["count"]) for x in value_counts_top(df, "v", k, counters).collect()]
        assert top == sorted(true.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_rare_values_do_not_cross_the_network(spark):
    """A near-unique column with a few frequent values: their candidates are told from the summaries."""
    df = spark.range(60_000).select(F.when(F.col("id") % 4 == 0, (F.col("id") / 4 % 5).cast("int")).otherwise(F.col("id") + 100).alias("v")).repartition(4)
    found = most_frequent(df, F.col("v"), 5, counters=1000)
    assert sorted(int(r.value) for r in found.collect()) == [0, 1, 2, 3, 4]
    assert [r["count"] for r in value_counts_top(df, "v", 5, counters=1000).collect()] == [3000] * 5
    assert value_counts_top(df.limit(0), "v", 5).count() == 0
