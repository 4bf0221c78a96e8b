import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_middle as fim


def brute(doc_id, text, rate=100, spm=50):
    """(n, form, output, prefix_chars, middle_chars) after the definition."""
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(m in t for m in fim.MARKS) or h[2] % 100 >= rate:
        return n, "plain", t, None, None
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=1, max_size=60), min_size=1, max_size=5), st.sampled_from([0, 1, 7, 1000]))
def test_index_is_exact_and_its_error_bounded(steps, error):
    parts = [np.cumsum(s) for s in steps]
    y, first = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]])
    index = fim.RankIndex(y, first, error)
    at = np.arange(len(y))
    assert (index[at] == y).all() and np.abs(index.predicted(at) - y).max() <= error
    assert set(first) <= set(index.start.tolist())


def test_segments_are_few_where_lines_are_alike():
    y = np.arange(100_000, dtype=np.int64) * 80 + np.random.default_rng(1).integers(0, 40, 100_000)
    index = fim.RankIndex(y, np.array([0]), 100)
    assert len(index.start) == 1 and index.residual.dtype == np.int16


def check(spark, rows, plan=fim.Plan()):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("id", "body", "n", "form", "prefix", "middle", "suffix", "h1")}).repartition(3)
    out = fim.transform(df, plan=plan).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in out) == \
        Counter((k, *brute(k, t, plan.rate, plan.spm)) for k, t in rows)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((k, t or "") for k, t in rows)
    return out


def test_awkward_texts(spark):
    long = "".join(f"line {i % 97} {'x' * (i * 7919 % 301)}\n" for i in range(20_000))
    texts = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\n漢字\r\n🙂", "x<P>y\nz", "a<\n<S\nb>", "<M>", long, long, "no end\n" * 3 + "tail", "\x00\n\x00"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a\nb\nc\n"), (3, "a\nb\n"), (3, "a\nb\n"), (-5, "p\nq\nr")] + [(100 + k, "one\ntwo\nthree\n") for k in range(50)]
    assert {r.form for r in check(spark, rows)} == {"plain", "psm", "spm"}
    check(spark, rows, fim.Plan(rate=40, spm=10, error=3))


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark, sf):
    from tessera.llm.queries import QUERIES
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_fill_middle"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, output, pre, mid = brute(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, pre, mid, sha(output), sha(texts[r.doc_id] or ""))
