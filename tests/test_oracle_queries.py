"""Every registered query against its DuckDB SQL (sf0.001), the driver's check in miniature."""

import importlib.util
import os
import re

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
spec = importlib.util.spec_from_file_location("oracle_check", os.path.join(ROOT, "scripts", "oracle_check.py"))
oc = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oc)

import __spark_entry__ as entry  # noqa: E402

OWN = re.compile(r"op\d+_|pipeline$")  # optional operators with tests of their own
QUERIES = {k: f for k, f in entry.queries().items() if not OWN.match(k)}
SQL = {k: q for k, q in entry.oracle_sql().items() if not OWN.match(k)}
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["article_sku", "measure", "provider_id", "sales_amount"]


def test_every_query_has_sql_or_is_documented():
    no_sql = set(QUERIES) - set(SQL)
    assert no_sql <= {"auto_map", "best_target", "header_candidates"}, no_sql
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF).toPandas()
    odf = duck.execute(SQL[name]).fetchdf()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert oc.digest(sdf) == oc.digest(odf)
