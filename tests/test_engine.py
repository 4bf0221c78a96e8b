"""Ports of the reference's unit assertions plus the deliberate deviations."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.lineage import FILE, ORD
from tessera.operators.validate import drift, validate
from tessera.plans.transform import ledger_counts, transform
from tessera.spec import HeaderCell, JobSpec, load_spec, save_spec


def _wide(spark):
    df = spark.createDataFrame([("s1", 1, 3), ("s2", 2, 4)], "article_sku string, Jan int, Feb int")
    return df.withColumn(FILE, F.lit("wide.csv")).withColumn(ORD, F.struct(F.monotonically_increasing_id().alias("i")))


def test_unpivot_metrics(spark):
    spec = JobSpec(sheet="Sheet1", columns=("article_sku", "Jan", "Feb"),
                   column_mappings={"article_sku": "article_sku"}, unpivot=True,
                   var_name="period", value_name="sales_amount", provider_name="acme")
    t = transform(_wide(spark), spec)
    out = t.frame
    assert {"article_sku", "period", "sales_amount", "provider_id"} <= set(out.columns)
    assert t.unpivot_info["columns_after"] == 3
    assert out.count() == 4
    assert {r["provider_id"] for r in out.collect()} == {"acme"}


def test_unpivot_keeps_melt_order_for_dedupe(spark):
    spec = JobSpec(column_mappings={"article_sku": "article_sku"}, unpivot=True, var_name="period",
                   value_name="v", dedupe_on=("article_sku",), provider_name="p")
    rows = transform(_wide(spark), spec).frame.orderBy("article_sku").collect()
    assert [(r["article_sku"], r["period"], r["v"]) for r in rows] == [("s1", "Jan", 1), ("s2", "Jan", 2)]


def test_schema_drift(spark):
    spec = JobSpec(sheet="Sheet1", columns=("a", "b", "c"))
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, extra int")
    missing, extra = drift(df, spec)
    assert missing == ["c"]
    assert extra == ["extra"]


def test_contract_required(spark):
    df = spark.createDataFrame([("p1", "sku", "2024-01-01", 1.0)],
                               "provider_id string, article_sku string, report_date string, sales_amount double")
    ok, errors = validate(df, JobSpec(required_fields=("article_sku",)), "contract")
    assert "article_sku" in ok.columns and errors.count() == 0
    assert ok.schema["report_date"].dataType.simpleString() == "timestamp_ntz"
    _, errors = validate(df, JobSpec(required_fields=("missing_field",)), "contract")
    rows = errors.collect()
    assert [(r["column"], r["failure_case"]) for r in rows] == [("missing_field", "missing required column")]


def test_validation_off_is_identity(spark):
    df = spark.createDataFrame([("x",)], "report_date string")
    out, errors = validate(df, JobSpec(), "off")
    assert out.schema == df.schema and errors.count() == 0


def test_spec_round_trip(tmp_path):
    spec = JobSpec.from_dict({
        "sheet_name": "Data", "header": 2, "skiprows": [0, 1], "unpivot": True,
        "header_mapping": {"SKU": "article_sku"}, "required_fields": ["article_sku", ""],
        "field_types": {"qty": "int"}, "combine_on": "article_sku, report_date",
        "drop_null_columns_threshold": "bad", "sheets": ["A", "B"],
        "headers": [{"name": "SKU", "column": 0, "row": 2, "alias": "article_sku"}]})
    assert spec.sheet == "Data" and spec.header_row == 2 and spec.skiprows == (0, 1)
    assert spec.combine_on == ("article_sku", "report_date")
    assert spec.drop_null_columns_threshold is None and spec.combine_sheets
    assert spec.columns == ("SKU",)
    path = tmp_path / "x.df-template.json"
    save_spec(spec, path)
    again = load_spec(path)
    assert again == spec
    assert json.loads(path.read_text())["required_fields"] == ["article_sku"]


def test_trim_keeps_null(spark):
    df = spark.createDataFrame([(" a ", None)], "x string, y string").withColumn(FILE, F.lit("f"))
    df = df.withColumn(ORD, F.struct(F.lit(0).alias("i")))
    out = transform(df, JobSpec(provider_name="p")).frame.collect()[0]
    assert out["x"] == "a" and out["y"] is None


def test_empty_rows_tested_before_stamp(spark):
    df = spark.createDataFrame([(None, None), ("a", None)], "x string, y string")
    df = df.withColumn(FILE, F.lit("f")).withColumn(ORD, F.struct(F.monotonically_increasing_id().alias("i")))
    t = transform(df, JobSpec(drop_empty_rows=True, provider_name="p"))
    assert t.frame.count() == 1
    counts = ledger_counts(t).collect()[0]
    assert counts["rows_in"] == 2 and counts["empty_rows"] == 1 and counts["rows_kept"] == 1


def test_date_parse_explicit_formats_and_counts(spark):
    df = spark.createDataFrame([("2024-01-31",), ("31.01.2024",), ("1700000000",), (None,)], "report_date string")
    df = df.withColumn(FILE, F.lit("f")).withColumn(ORD, F.struct(F.monotonically_increasing_id().alias("i")))
    t = transform(df, JobSpec(provider_name="p"))
    assert t.frame.count() == 1
    c = ledger_counts(t).collect()[0]
    assert c["date_parse_failures"] == 2
    t2 = transform(df, JobSpec(provider_name="p", date_formats=("yyyy-MM-dd", "dd.MM.yyyy")))
    assert t2.frame.count() == 2


def test_int_with_fraction_fails_cell(spark):
    from tessera.operators.clean import coerce_types, failure_counts
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), ("3.0",)], "q string")
    out, _ = coerce_types(df, {"q": "int"})
    assert [r["q"] for r in out.collect()] == [1, None, None, 3]
    assert failure_counts(df, {"q": "int"}).collect()[0]["failures"] == 2


def test_number_shapes():
    from tessera.functions import to_num
    from tessera.session import build_session
    spark = build_session()
    vals = ["1d", "nan", "1,234", "", "0x10", "True", "1e3", " 12 ", "1_000", "-.5", "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["n"] for r in df.select(to_num("v").alias("n")).collect()]
    assert got[:6] == [None] * 6
    assert got[6] == 1000.0 and got[7] == 12.0 and got[8] is None and got[9] == -0.5
    assert got[10] == float("inf")


def test_group_sum_drops_null_keys_and_all_null_groups(spark):
    from tessera.operators.aggregate import group_sum
    df = spark.createDataFrame([("a", 1.0, True), ("a", None, False), (None, 5.0, True), ("b", None, None)],
                               "k string, v double, b boolean")
    out = {r["k"]: (r["v"], r["b"]) for r in group_sum(df, ["k"]).collect()}
    assert out == {"a": (1.0, 1), "b": (None, None)}


def test_positional_select_by_index(spark):
    from tessera.operators.project import positional_select
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    spec = JobSpec(headers=(HeaderCell("C", 2, 0), HeaderCell("A", 0, 0, alias="first")),
                   column_mappings={"C": "third"})
    out = positional_select(df, spec)
    assert out.columns == ["third", "first"]
    assert out.collect()[0].asDict() == {"third": 2.0, "first": 1}


def test_sparse_columns_per_file(spark):
    from tessera.operators.filters import drop_sparse_columns
    rows = [("a.csv", 1, "x", None), ("a.csv", 2, "y", None), ("b.csv", 3, None, "p"), ("b.csv", 4, "z", None)]
    df = spark.createDataFrame(rows, f"{FILE} string, k int, c string, d string")
    out = drop_sparse_columns(df, 0.6)
    # c: a keeps (1.0), b drops (0.5) -> kept, nulled in b; d: a drops (0.0), b drops (0.5) -> gone
    assert "d" not in out.columns and "c" in out.columns
    got = sorted((r[FILE], r["k"], r["c"]) for r in out.collect())
    assert got == [("a.csv", 1, "x"), ("a.csv", 2, "y"), ("b.csv", 3, None), ("b.csv", 4, None)]
