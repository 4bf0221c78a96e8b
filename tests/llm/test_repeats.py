import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.queries import QUERIES
from tessera.llm.repeats import Cut, remove_repeats
from tessera.llm.suffixes import Suffixes


def brute(texts: list, length: int) -> list:
    """(kept, removed bytes, runs) of each text."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i: i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                hit[i + 1: i + 1 + length] = True
        out.append((bytes(x for x, h in zip(b, hit[1:]) if not h), int(hit.sum()), int((hit[1:] & ~hit[:-1]).sum())))
    return out


def check(spark, texts, cut):
    df = spark.createDataFrame([(k % 5 if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("id", "body", "key", "ctx", "start", "n", "runs", "o1", "kept", "at", "length")}).repartition(5)
    got = Counter((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in remove_repeats(df, cut=cut).collect())
    want = Counter((k % 5 if k % 7 else None, *w) for k, w in enumerate(brute(texts, cut.length)))
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=30) | st.text(max_size=10), min_size=1, max_size=6), st.integers(1, 17))
def test_suffix_order_and_common_prefixes(texts, depth):
    strings = [t.encode("utf-8", "surrogatepass") for t in texts]
    s = Suffixes(strings, depth)
    whole = {int(b) + i: x[i: i + depth] for b, x in zip(s.begin, strings) for i in range(len(x) - depth + 1)}
    assert sorted(s.order.tolist()) == sorted(whole)
    keys = [whole[p] for p in s.order.tolist()]
    assert keys == sorted(keys)
    assert s.common().tolist() == [next((i for i in range(depth) if a[i] != b[i]), depth) for a, b in zip(keys, keys[1:])]
    often = Counter(keys)
    assert s.repeated().tolist() == sorted(p for p, x in whole.items() if often[x] > 1)


def passages(seed: int) -> list:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9)))
    some = lambda n: "".join(word() for _ in range(n))
    shared = [some(r.randrange(2, 60)) for _ in range(4)]
    texts = [some(r.randrange(0, 20)) + r.choice(shared) + some(r.randrange(0, 20)) + r.choice(shared + [""]) for _ in range(60)]
    copies = [texts[0]] * 5 + [texts[1].replace("a", "b", 1), None, None, "", "x", "aa" * 300, "ab" * 200, shared[0], shared[0]]
    return texts + copies


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cut", [Cut(40, 10), Cut(40, 10, many=3, sort_bytes=300), Cut(40, 16, blocks=(5, 2, 1), many=1, piece=64, sort_bytes=1), Cut(33, 33)])
def test_against_brute_force(spark, seed, cut):
    check(spark, passages(seed), cut)


def test_crowded_passage(spark):
    """One passage in many surroundings: its keys are cut into blocks of windows, then into windows."""
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh") for _ in range(130))
    line = "".join(r.choice("abcdefgh") for _ in range(30))
    around = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 70)))
    check(spark, [around() + passage + around() + line + around() for _ in range(150)], Cut(40, 12, many=20))


def test_empty_table_and_short_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).collect() == []
    check(spark, [None, "", "short", "short"], Cut())


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], 400))}
    import hashlib
    got = QUERIES["op12_suffix_dedup"](spark, sf).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r.doc_id)):
        kept, removed, spans = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len((t.text or "").encode()), removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
