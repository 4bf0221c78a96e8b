"""Property tests: Spark column functions against plain-Python statements of the same rules."""

import re

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from tessera.functions import header_norm, month_token, snake_case, to_num, year_month_label
from tessera.functions.text import MONTH_ABBREVIATIONS, MONTH_WORDS

SETTINGS = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

NUM = re.compile(r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$")


def py_num(s):
    if s is None or not NUM.match(s):
        return None
    return float(s.strip())


def py_snake(s):
    cleaned = "".join(ch if ch.isalnum() else "_" for ch in s)
    cleaned = re.sub("_+", "_", cleaned)
    return cleaned.strip("_").lower()


def py_norm(s):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9]+", " ", s.lower())).strip()


def py_month(s):
    low = s.lower()
    if low in MONTH_WORDS:
        return MONTH_WORDS[low]
    for a in MONTH_ABBREVIATIONS:
        if a in low:
            return a
    return None


def py_label(s):
    parts = s.replace("/", " ").replace("-", " ").split()
    year = next((p for p in parts if re.fullmatch(r"[0-9]{4}", p)), None)
    month = next((py_month(p) for p in parts if py_month(p)), None)
    return f"{year}-{month}" if year and month else s


numberish = st.text(alphabet="0123456789+-.eE xiInNfFdD_,", max_size=10)
labelish = st.text(alphabet="abcdefghijklmnopqrstuvwxyzäöABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 -/_#.()", max_size=24)
words = st.sampled_from(sorted(MONTH_WORDS) + ["Jan.", "Sept", "okt", "x", "2021", "MAR", "q1"])


def _run(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r["o"] for r in df.select(fn("v").alias("o")).collect()]


@settings(**SETTINGS)
@given(st.lists(numberish, min_size=1, max_size=200))
def test_to_num_matches_rule(spark, values):
    got = _run(spark, values, to_num)
    want = [py_num(v) for v in values]
    assert got == want


@settings(**SETTINGS)
@given(st.lists(labelish, min_size=1, max_size=200))
def test_snake_case_and_norm(spark, values):
    assert _run(spark, values, snake_case) == [py_snake(v) for v in values]
    assert _run(spark, values, header_norm) == [py_norm(v) for v in values]


@settings(**SETTINGS)
@given(st.lists(st.builds(lambda a, b, sep: f"{a}{sep}{b}", st.sampled_from(["2020", "1999", "abc", "20201"]),
                          words, st.sampled_from([" ", "/", "-", "  "])), min_size=1, max_size=100),
       st.lists(words, min_size=1, max_size=50))
def test_month_token_and_year_month(spark, labels, tokens):
    assert _run(spark, tokens, month_token) == [py_month(t) for t in tokens]
    assert _run(spark, labels, year_month_label) == [py_label(v) for v in labels]
