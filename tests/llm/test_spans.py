import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm import spans as S


def covered(text, spans, mark="<{}>"):
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], mark.format(k)]
        at = max(at, e)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 63, 65, 1100, 3000])
def test_places_and_redaction_equal_plain_search(spark, n):
    r = random.Random(n)
    text = "".join(r.choice(["ab", "é1", "🙂", " 77", "a9b", "\n"]) + r.choice(["", "x", "12 "]) for _ in range(n))
    df = spark.createDataFrame([(text,)], "t string")
    keep = lambda m, g: F.length(g) < 3
    got = df.select(S.find(F.col("t"), "d", "[a-z]?([0-9]+)", keep, 1)).first()[0]
    assert [tuple(s) for s in got] == [("d", m.start(), m.end()) for m in re.finditer("[a-z]?([0-9]+)", text) if len(m[1]) < 3]
    spans = [(r.choice("kl"), a, a + r.randrange(1, 9)) for a in r.sample(range(len(text)), len(text) // 3)] if text else []
    spans = [(k, a, min(b, len(text))) for k, a, b in spans]
    df = spark.createDataFrame([(text, spans)], f"t string, s {S.SPAN}")
    assert df.select(S.redacted(F.col("t"), F.col("s"), lambda k: F.concat(F.lit("<"), k, F.lit(">")))).first()[0] == covered(text, spans)


def test_a_long_text_full_of_findings_takes_time_in_proportion(spark):
    """One text of 5 MB with 100,000 findings is scanned and redacted in seconds."""
    text = "".join(f"row {i} token = 0123456789abcdef{i:06d} and more words\n" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    found = secrets.scan(docs, keep=("doc_id", "text"))
    out = found.select("spans", S.redacted(F.col("text"), F.col("spans"), lambda k: F.concat(F.lit("<"), k, F.lit(">"))).alias("t")).first()
    took = time.perf_counter() - began
    assert len(text) > 5_000_000 and sum(s.kind == "assign" for s in out.spans) == 100_000
    assert out.t.splitlines()[77_777] == "row 77777 <assign> and more words"
    assert took < 120, took
