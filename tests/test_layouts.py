"""Date layouts settled by what a file's column holds."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators.lineage import FILE
from tessera.operators.layouts import date_layouts, parse_by_layout, parse_dates


def test_shapes(spark):
    d = datetime
    cases = [("03/04/2024", d(2024, 3, 4), d(2024, 4, 3)), ("3.4.24", d(2024, 3, 4), d(2024, 4, 3)), ("03-04-1970", d(1970, 3, 4), d(1970, 4, 3)),
             ("1/2/85", d(1985, 1, 2), d(1985, 2, 1)), ("13/04/2024", None, d(2024, 4, 13)), ("04/13/2024", d(2024, 4, 13), None),
             *[(t, x, x) for t, x in [("2024-03-04", d(2024, 3, 4)), ("2024/3/4", d(2024, 3, 4)), ("2024.03.04 5:06", d(2024, 3, 4, 5, 6)),
                                      ("2024-03-04T05:06:07", d(2024, 3, 4, 5, 6, 7)), (" 2024-02-29 ", d(2024, 2, 29)), ("2023-02-29", None), ("2024-13-01", None),
                                      ("4 March 2024", d(2024, 3, 4)), ("4-Mar-24", d(2024, 3, 4)), ("4. maaliskuu 2024", d(2024, 3, 4)), ("March 4, 2024", d(2024, 3, 4)),
                                      ("mar 4 2024 10:11:12", d(2024, 3, 4, 10, 11, 12)), ("4 nomonth 2024", None), ("", None), ("x", None), (None, None), ("45000", None),
                                      ("1/2/3/4", None), ("31/31/2024", None)]]]
    df = spark.createDataFrame([(t,) for t, *_ in cases], "t string")
    got = df.select("t", parse_by_layout(F.col("t"), F.lit(False)).alias("m"), parse_by_layout(F.col("t"), F.lit(True)).alias("d")).collect()
    assert [tuple(r) for r in got] == cases


def test_extremes_settle_the_files_layout(spark):
    rows = [("a", "01/02/2024", "x"), ("a", "25/02/2024", "x"), ("a", "junk", "x"), ("b", "01/02/2024", "x"), ("b", "02/25/2024", "1/13/20"),
            ("c", "01/02/2024", None), ("c", "2024-02-25", "y"), ("d", None, None)]
    df = spark.createDataFrame(rows, f"{FILE} string, t string, u string")
    found = {(r[FILE], r["column"]): (r.as_day_first, r.as_month_first, r.day_first) for r in date_layouts(df, ["t", "u"]).collect()}
    assert found["a", "t"] == (2, 1, True) and found["b", "t"] == (1, 2, False) and found["c", "t"] == (1, 1, False) and found["d", "t"] == (0, 0, False)
    assert found["b", "u"] == (0, 1, False)
    out = {(r[FILE], r.t): r.t_ for r in parse_dates(df, ["t"], suffix="_").collect()}
    assert out["a", "01/02/2024"] == datetime(2024, 2, 1) and out["b", "01/02/2024"] == datetime(2024, 1, 2) and out["c", "01/02/2024"] == datetime(2024, 1, 2)
    assert out["a", "25/02/2024"] == datetime(2024, 2, 25) and out["a", "junk"] is None
    either = {(r[FILE], r.t): r.t_ for r in parse_dates(df, ["t"], day_first=True, suffix="_").collect()}
    assert either["c", "01/02/2024"] == datetime(2024, 2, 1) and either["b", "01/02/2024"] == datetime(2024, 1, 2)
    assert parse_dates(df.where(f"{FILE} = 'a'"), ["t"]).where("t IS NULL").count() == 1
    assert parse_dates(df.limit(0), ["t"]).count() == 0


def test_template_with_guessed_dates(spark):
    from tessera.plans.transform import DATE_BAD, transform
    from tessera.spec import JobSpec
    rows = [("a", "A", "25/02/2024"), ("a", "B", "01/02/2024"), ("a", "C", "soon"), ("b", "A", "02/25/2024"), ("b", "B", "01/02/2024")]
    df = spark.createDataFrame(rows, f"{FILE} string, article_sku string, report_date string")
    spec = JobSpec(guess_dates=True, provider_name="p")
    assert JobSpec.from_dict(spec.to_dict()).guess_dates
    t = transform(df, spec)
    assert {(r[FILE], r.article_sku, r.report_date) for r in t.frame.collect()} == {
        ("a", "A", datetime(2024, 2, 25)), ("a", "B", datetime(2024, 2, 1)), ("b", "A", datetime(2024, 2, 25)), ("b", "B", datetime(2024, 1, 2))}
    assert t.flagged.where(DATE_BAD).count() == 1
