import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jaccard_join, signature_tree
from tessera.llm.queries import ORACLE, QUERIES
from tessera.llm.shingles import shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(comp[a], comp[b])
            if comp[a] != least or comp[b] != least:
                comp[a] = comp[b] = least
                changed = True
    return sorted((str(i), len(s), str(c)) for (i, _), s, c in zip(rows, sets, comp)), len(links)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZ éÉ\t\n\x0b\x0c\r\x1c İ"), max_size=40), max_size=6))
def test_shingle_counts(texts):
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(texts[i]) & shingles(texts[j]))


@pytest.mark.parametrize("seed", range(3))
def test_signature_trees_lose_no_pair(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for k in range(120):
        s = rng.integers(0, 2 ** 63, rng.integers(1, 200), dtype=np.uint64) if k % 3 == 0 or not sets else sets[rng.integers(len(sets))]
        keep = rng.random(len(s)) > rng.choice([0, 0.05, 0.12, 0.2])
        s = np.unique(np.concatenate([s[keep], rng.integers(0, 2 ** 63, int(rng.integers(0, 1 + len(s) // 10)), dtype=np.uint64)]))
        sets.append(s if len(s) else np.array([1], np.uint64))
    sizes, bits = np.array([len(s) for s in sets]), [signature_tree.bitmap(s) for s in sets]
    want = {(a, b) for a in range(120) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    rows = np.arange(120)
    got = [(max(a, b), min(a, b)) for x, y in signature_tree.candidates(bits, sizes, rows, None, 80, 100) for a, b in zip(x.tolist(), y.tolist())]
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < 120 * 119 / 4
    across = {(max(a, b), min(a, b)) for x, y in signature_tree.candidates(bits, sizes, rows[:50], rows[50:], 80, 100) for a, b in zip(x.tolist(), y.tolist())}
    assert {p for p in want if (p[0] < 50) != (p[1] < 50)} <= across


def corpus(seed, n):
    """Chains of copies with edits about the threshold, passages shared by many texts, and short texts."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 500, k)]
    passage, rows = word(30), []
    for k in range(n):
        if rows and k % 2:
            w = list(rows[rng.integers(len(rows))][1].split())
            for _ in range(int(rng.integers(0, 1 + len(w) // 40))):
                w[rng.integers(len(w))] = "edit" + str(rng.integers(99))
            if rng.random() < 0.3:
                w += word(int(rng.integers(1, 5)))
        else:
            w = word(int(rng.integers(3, 120)))
            if rng.random() < 0.5:
                w = w[:20] + passage + w[20:]
        rows.append((n - k, " ".join(w)))
    return rows


@pytest.mark.parametrize("settings_", [jaccard_join.Join(), jaccard_join.Join(chunk=8, rounds=1), jaccard_join.Join(rounds=0, extra=0.3, token_bits=15, id_bits=15)])
def test_classes_equal_brute_force(spark, settings_):
    rows = corpus(4, 160)
    want, links = brute(rows)
    assert links > 50
    assert result(jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), settings=settings_)) == want


def test_awkward_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(jaccard_join.link(documents)) == brute(rows)[0]
    assert jaccard_join.link(documents.limit(0)).count() == 0


def test_query_equals_sql(spark, duck, sf):
    got = sorted(tuple(r) for r in QUERIES["op7_jaccard_join"](spark, sf).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(duck.execute(ORACLE["op7_jaccard_join"]).fetchall())
