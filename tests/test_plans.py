"""The physical plans we want: pushdown, pruning, map-side combining, no cartesian joins."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name,pushed", [
    ("filter_eq", "EqualTo(l_returnflag,R)"),
    ("filter_gt", "GreaterThan(l_quantity,45.0)"),
    ("filter_le", "LessThanOrEqual(l_tax,0.01)"),
    ("filter_sql", "StringContains(p_name,ring)"),
    ("stack_strict", "GreaterThanOrEqual(o_orderdate"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


def test_projection_pruned_at_scan(spark):
    p = plan(spark, "provider_totals")
    read = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert read and all("l_comment" not in r and "l_shipdate" not in r for r in read)
    assert "l_suppkey" in read[0] and "l_discount" in read[0]


def test_partial_aggregation_and_group_limit(spark):
    assert "partial_min_by" in plan(spark, "dedupe_first")
    assert "partial_sum" in plan(spark, "group_sum")
    assert "WindowGroupLimit" in plan(spark, "preview_rows")
    assert "WindowGroupLimit" in plan(spark, "auto_map")
