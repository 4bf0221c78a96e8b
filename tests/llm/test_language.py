"""Language mixtures against expectation-maximisation written out in plain Python."""

import math

import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.llm.common import held_out

M = (1 << 64) - 1


def code(a, b, c, bits):
    x = (ord(a) * 0x9E3779B97F4A7C15 ^ ord(b) * 0xC2B2AE3D27D4EB4F ^ ord(c) * 0x165667B19E3779F9) & M
    x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9 & M) >> (64 - bits)


def likelihoods(text, model):
    """Per word, the log-likelihood under each language: trigrams around its characters and around the blank behind it."""
    words = [w for w in regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()) if regex.search(r"\p{L}", w)]
    out = []
    for i, w in enumerate(words):
        behind = words[i + 1][0] if i + 1 < len(words) else " "
        s = f" {w} {behind}"
        out.append([sum(float(model.logp[code(*s[j: j + 3], model.fit.bits), k]) for j in range(len(w) + 1)) for k in range(len(model.languages))])
    return out


def mixture(like, model):
    """{language: share} of the set with the best penalised likelihood."""
    k, n = len(model.languages), len(like)
    odds = [[math.exp(x - max(row)) for x in row] for row in like]

    def run(some):
        pi = [1 / len(some) if j in some else 0.0 for j in range(k)]
        for _ in range(model.fit.rounds):
            new = [0.0] * k
            for row in odds:
                total = sum(a * b for a, b in zip(row, pi)) + 1e-300
                for j in some:
                    new[j] += row[j] * pi[j] / total
            pi = [x / n for x in new]
        return pi, sum(math.log(sum(a * b for a, b in zip(row, pi)) + 1e-300) for row in odds)

    cost = model.fit.penalty * math.log(n + 1)
    full, gain = run(range(k))
    single = [sum(math.log(max(row[j], 1e-300)) for row in odds) for j in range(k)]
    best = max(range(k), key=lambda j: (single[j], -j))
    value, chosen = single[best] - cost, {model.languages[best]: 1.0}
    if gain - 2 * cost > value:
        order = sorted(range(k), key=lambda j: -full[j])
        for size in range(2, k + 1):
            pi, g = run(order[:size])
            if g - size * cost > value:
                value, chosen = g - size * cost, {model.languages[j]: pi[j] for j in order[:size]}
    return chosen


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~held_out()))


def test_against_plain_expectation_maximisation(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 700).alias("text"))
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text][:60]
    texts += [a[:300] + " " + b[:300] for a, b in zip(texts, texts[7:])][:30] + ["", None, "7 8", "a", "❤️ 100", "é", "the the"]
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    several = 0
    for r in got:
        like = likelihoods(texts[r.doc_id], model)
        if not like:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        want = mixture(like, model)
        mine = {k: v for k, v in r.languages.items() if v > 1e-9}
        assert mine.keys() == {k for k, v in want.items() if v > 1e-9}, (texts[r.doc_id], mine, want)
        assert all(abs(mine[k] - want[k]) < 1e-4 for k in mine)
        assert abs(r.score - max(want.values())) < 1e-4 and want[r.lang_pred] >= max(want.values()) - 1e-4
        several += len(mine) > 1
    assert several > 5


def test_a_result_does_not_depend_on_the_neighbours(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, other = ({r.doc_id: (r.lang_pred, r.score) for r in language.predict(d, model).collect()} for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(7)))
    assert one == other
