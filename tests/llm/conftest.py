import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward documents: nulls in any column, empty and blank texts, a long one, equal rows and extra columns named as columns the
    operators use themselves."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    said = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, said, "en", "a"), (2, said.upper(), "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "en", None),
            (6, long, None, "b"), (7, long, "en", "b"), (8, said + " thirteen", "de", "c"), (8, said + " thirteen", "de", "c"),
            (None, said, "en", "a"), (10, "ß 漢字 emoji 🙂 <|endoftext|> it's 3.14", "en", ""), (11, "three words only", "en", "c"),
            (12, "Three words ONLY", "en", "c"), (13, "1234", "en", "c")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["size", "src", "salt", "rep", "token", "n", "blob", "spans", "id", "y", "label", "score", "c0", "u", "h"]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], kinds)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
