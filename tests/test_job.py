"""End-to-end: the batch job over a folder, the incremental stream, and the folder combine."""

import os

from pyspark.sql import functions as F

from tessera.operators.lineage import FILE
from tessera.plans.combine import run_combine
from tessera.plans.job import run_job
from tessera.sinks.outputs import run_status
from tessera.spec import JobSpec
from tessera.streaming.incremental import start_incremental
from xlsx_writer import grid, write_xlsx

SPEC = JobSpec(source_type="csv", column_mappings={"sku": "article_sku"}, unpivot=True,
               var_name="report_date", value_name="sales_amount", provider_name="acme",
               strip_thousands=True, combine_on=("article_sku",))


def _inputs(d):
    d.mkdir(parents=True, exist_ok=True)
    (d / "good.csv").write_text("sku,2024-01-31,2024-02-29\nA,\"1,000\",2\nB,3,4\nA,5,6\n")
    (d / "bad.csv").write_text("sku,2024-01-31,Feb\nC,x,1\n")


def test_job_writes_clean_quarantine_and_ledger(spark, tmp_path):
    _inputs(tmp_path / "in")
    res = run_job(spark, SPEC, str(tmp_path / "in"), str(tmp_path / "out"), kind="csv", level="coerce")
    ledger = {r[FILE]: r for r in res.ledger.collect()}
    assert ledger["good.csv"]["status"] == "processed"
    assert ledger["good.csv"]["rows_in"] == 6 and ledger["good.csv"]["rows_kept"] == 6
    assert ledger["good.csv"]["rows_out"] == 4
    assert ledger["bad.csv"]["date_parse_failures"] == 1
    assert ledger["bad.csv"]["numeric_parse_failures"] == 1
    clean = spark.read.parquet(res.clean_path)
    got = sorted((r["article_sku"], str(r["report_date"])[:10], r["sales_amount"]) for r in
                 clean.where(F.col(FILE) == "good.csv").collect())
    assert got == [("A", "2024-01-31", 1005.0), ("A", "2024-02-29", 8.0), ("B", "2024-01-31", 3.0),
                   ("B", "2024-02-29", 4.0)]
    status = {r["status"]: r["files"] for r in run_status(spark.read.parquet(res.ledger_path)).collect()}
    assert status["processed"] == 2
    assert res.totals["rows_written"] == 5 and abs(res.totals["sales_amount_total"] - 1020.0) < 1e-9


def test_job_contract_failure_quarantines(spark, tmp_path):
    _inputs(tmp_path / "in")
    spec = SPEC.with_(required_fields=("region",))
    res = run_job(spark, spec, str(tmp_path / "in"), str(tmp_path / "out"), kind="csv", level="contract")
    statuses = {r[FILE]: r["status"] for r in res.ledger.collect()}
    assert set(statuses.values()) == {"quarantined"}
    q = spark.read.parquet(res.quarantine_path)
    assert q.count() == 4 and {r["reason"] for r in q.collect()} == {"Validation failed."}


def test_job_on_workbooks_with_fallback(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write_xlsx(d / "a.xlsx", {"S": grid(["sku", "amount"], [["A", 1], ["B", 2.5]])})
    (d / "b.xlsx").write_text("sku,amount\nC,3\n")
    spec = JobSpec(sheet="S", columns=("sku", "amount"),
                   column_mappings={"sku": "article_sku", "amount": "sales_amount"}, provider_name="p")
    res = run_job(spark, spec, str(d), str(tmp_path / "out"), kind="excel")
    clean = spark.read.parquet(res.clean_path)
    assert sorted((r["article_sku"], r["sales_amount"]) for r in clean.collect()) == [("A", 1.0), ("B", 2.5), ("C", 3.0)]


def test_incremental_stream(spark, tmp_path):
    inbox, out, arch = tmp_path / "inbox", tmp_path / "out", tmp_path / "archive"
    _inputs(inbox)
    q = start_incremental(spark, SPEC, str(inbox), str(out), archive_dir=str(arch),
                          checkpoint=str(tmp_path / "ckpt"), kind="csv")
    q.awaitTermination(120)
    first = spark.read.parquet(str(out / "batch=0" / "clean"))
    assert first.count() == 5          # good.csv 4 rows, bad.csv 1 (amount x -> 0.0)
    (inbox / "later.csv").write_text("sku,2024-03-31\nZ,9\n")
    q = start_incremental(spark, SPEC, str(inbox), str(out), archive_dir=str(arch),
                          checkpoint=str(tmp_path / "ckpt"), kind="csv")
    q.awaitTermination(120)
    batches = sorted(p for p in os.listdir(out) if p.startswith("batch="))
    assert len(batches) == 2
    second = spark.read.parquet(str(out / batches[1] / "clean"))
    assert [r["article_sku"] for r in second.collect()] == ["Z"]


def test_run_combine(spark, tmp_path):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").write.parquet(str(tmp_path / "a.parquet"))
    o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus").write.parquet(str(tmp_path / "b.parquet"))
    stacked = run_combine(spark, str(tmp_path), "*.parquet", "concat")
    assert stacked.count() == o.count() and set(stacked.columns) == {"o_orderkey", "o_totalprice", "o_orderstatus"}
    merged = run_combine(spark, str(tmp_path), "*.parquet", "merge", ["o_orderkey"], "outer")
    assert merged.count() == o.count()
    try:
        run_combine(spark, str(tmp_path), "*.parquet", "concat", strict_schema=True)
        raise AssertionError("strict stack should fail")
    except ValueError as exc:
        assert "b.parquet" in str(exc)


def test_ledger_raw_counts_and_retry(spark, tmp_path):
    from tessera.plans.job import retry_quarantined
    _inputs(tmp_path / "in")
    spec = SPEC.with_(required_fields=("region",))
    res = run_job(spark, spec, str(tmp_path / "in"), str(tmp_path / "out"), kind="csv", level="contract")
    led = {r[FILE]: r for r in res.ledger.collect()}
    assert led["good.csv"]["raw_rows"] == 3 and led["good.csv"]["columns_in"] == 4
    assert led["good.csv"]["path"].endswith("good.csv")
    again = retry_quarantined(spark, SPEC, res.ledger_path, str(tmp_path / "out2"), kind="csv")
    assert {r["status"] for r in again.ledger.collect()} == {"processed"}


def test_type_labels(spark):
    from tessera.operators.aggregate import type_labels
    df = spark.createDataFrame([(True, 1, 1.5, "x")], "b boolean, i int, d double, s string") \
        .withColumn("t", F.current_timestamp())
    assert type_labels(df) == [("b", "Boolean"), ("i", "Number"), ("d", "Number"), ("s", "Text"), ("t", "Date")]


def test_preflight_and_csv_output(spark, tmp_path):
    from tessera.sinks.outputs import write_frame
    from tessera.sources.csv import read_csv
    from tessera.sources.files import list_files, preflight
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (d / "empty.csv").write_text("x,y\n")
    frame = read_csv(spark, str(d), JobSpec(source_type="csv"))
    pf = {r[FILE]: (r["rows"], r["columns"], r["status"])
          for r in preflight(spark, list_files(spark, str(d)), frame).collect()}
    assert pf == {"a.csv": (2, 2, "OK"), "empty.csv": (0, 0, "Empty")}
    from tessera.sources import workbook as wb
    (d / "broken.xlsx").write_bytes(b"PK\x03\x04garbage")
    errs = wb.decode_errors(wb.decode(spark, str(d / "broken.xlsx")))
    pf2 = {r[FILE]: r["status"] for r in preflight(spark, list_files(spark, str(d)), frame, errs).collect()}
    assert pf2["broken.xlsx"].startswith("error: ")
    out = write_frame(frame, str(tmp_path / "out_csv"), "csv")
    back = spark.read.option("header", True).csv(out)
    assert sorted((r["x"], r["y"]) for r in back.collect()) == [("1", "2"), ("3", "4")]


def test_job_sums_inferred_number_columns(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "s.csv").write_text("sku,qty,price,note\nA,1,2.5,x\nA,2,0.5,y\nB,3,1.0,z\n")
    spec = JobSpec(source_type="csv", combine_on=("sku",), provider_name="p")
    res = run_job(spark, spec, str(d), str(tmp_path / "out"), kind="csv")
    got = sorted((r["sku"], r["qty"], r["price"]) for r in spark.read.parquet(res.clean_path).collect())
    assert got == [("A", 3, 3.0), ("B", 3, 1.0)]
    cols = spark.read.parquet(res.clean_path).columns
    assert "note" not in cols      # text columns leave a group sum


def test_job_on_parquet_per_file_groups(spark, tmp_path):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    d = tmp_path / "in"
    o.where("o_orderstatus = 'F'").coalesce(1).write.parquet(str(d / "f.parquet"))
    o.where("o_orderstatus <> 'F'").coalesce(1).write.parquet(str(d / "rest.parquet"))
    spec = JobSpec(source_type="parquet", columns=("o_custkey", "o_totalprice", "o_orderpriority"),
                   column_mappings={"o_totalprice": "sales_amount"}, combine_on=("o_custkey",),
                   provider_name="p")
    res = run_job(spark, spec, [str(d / "f.parquet"), str(d / "rest.parquet")], str(tmp_path / "out"),
                  kind="parquet")
    out = spark.read.parquet(res.clean_path)
    got = sorted((r["o_custkey"], round(r["sales_amount"], 2)) for r in out.collect())
    pdf = o.toPandas()
    pdf["grp"] = (pdf["o_orderstatus"] == "F")
    want = sorted((int(k), round(v, 2)) for (k, _g), v in pdf.groupby(["o_custkey", "grp"])["o_totalprice"].sum().items())
    assert got == want                      # groups stay inside their source file
    assert {r["status"] for r in res.ledger.collect()} == {"processed"}


SUM = JobSpec(source_type="csv", combine_on=("sku",), provider_name="p")


def test_same_name_in_two_folders(spark, tmp_path):
    for folder, text in (("acme", "sku,amount\nA,1\nB,2\n"), ("beta", "article,sku\nx,C\n")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "jan.csv").write_text(text)
    spec = JobSpec(source_type="csv", provider_name="p")
    res = run_job(spark, spec, str(tmp_path / "in"), str(tmp_path / "out"), kind="csv", root=str(tmp_path / "in"))
    rows = spark.read.option("mergeSchema", True).parquet(res.clean_path).collect()
    assert sorted((r["company"], r["sku"], r["article"]) for r in rows) == [("acme", "A", None), ("acme", "B", None), ("beta", "C", "x")]
    led = sorted((r["path"].split("/")[-2], r["rows_in"], r["rows_out"], r["status"]) for r in res.ledger.collect())
    assert led == [("acme", 2, 2, "processed"), ("beta", 1, 1, "processed")]


def test_required_columns_are_those_of_each_file(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "one.csv").write_text("article_sku,amount\nA,1\n")
    (d / "two.csv").write_text("sku,amount\nB,2\n")
    spec = JobSpec(source_type="csv", provider_name="p", required_fields=("article_sku",))
    res = run_job(spark, spec, str(d), str(tmp_path / "out"), kind="csv", level="contract")
    assert {r[FILE]: (r["status"], r["errors"]) for r in res.ledger.collect()} == {"one.csv": ("processed", 0), "two.csv": ("quarantined", 1)}


def test_sums_do_not_depend_on_other_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("sku,qty,w\nA,1,1\nA,2,1\n")
    (d / "b.csv").write_text("sku,qty,w\nA,1,2\nA,many,3\n")
    res = run_job(spark, SUM, str(d), str(tmp_path / "out"), kind="csv")
    got = sorted((r[FILE], r["sku"], r["qty"], r["w"]) for r in spark.read.parquet(res.clean_path).collect())
    assert got == [("a.csv", "A", 3, 2), ("b.csv", "A", None, 5)]


def test_header_guess_is_each_files_own_and_follows_skipped_rows(spark, tmp_path):
    from tessera.plans.job import scan
    d = tmp_path / "in"
    d.mkdir()
    (d / "narrow.csv").write_text("Title\nsku,amount\nA,1\n")
    (d / "wide.csv").write_text("a,b,c,d,e,f,g,h\n1,2,3,4,5,6,7,8\n")
    spec = JobSpec(source_type="csv")
    rows = {r[FILE]: r for r in scan(spark, spec, str(d), "csv", guess_header=True).collect()}
    assert rows["narrow.csv"]["sku"] == "A" and rows["wide.csv"]["h"] == 8
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "s.csv").write_text("junk,text\nmore,junk\nx,y\n1,2\n3,4\n")
    out = scan(spark, spec.with_(skiprows=(0, 1)), str(tmp_path / "skip"), "csv", guess_header=True)
    assert sorted((r["x"], r["y"]) for r in out.collect()) == [(1, 2), (3, 4)]


def test_inputs_without_rows_and_unreadable_ones_are_in_the_ledger(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write_xlsx(d / "a.xlsx", {"S": grid(["sku", "amount"], [["A", 1]])})
    write_xlsx(d / "empty.xlsx", {"S": grid(["sku", "amount"], [])})
    (d / "broken.xlsx").write_bytes(b"PK\x03\x04garbage")
    res = run_job(spark, JobSpec(sheet="S", provider_name="p"), str(d), str(tmp_path / "out"), kind="excel")
    led = {r[FILE]: r for r in res.ledger.collect()}
    assert {k: (r["status"], r["rows_in"]) for k, r in led.items()} == {"a.xlsx": ("processed", 1), "empty.xlsx": ("processed", 0), "broken.xlsx": ("quarantined", 0)}
    assert led["broken.xlsx"]["message"].startswith("Could not be read") and led["empty.xlsx"]["message"] == "No data rows."
    q = spark.read.parquet(res.quarantine_path).collect()
    assert [(r[FILE], r["reason"][:17]) for r in q] == [("broken.xlsx", "Could not be read")]


def test_a_retry_keeps_the_good_files_rows(spark, tmp_path):
    from tessera.plans.job import retry_quarantined
    d = tmp_path / "in"
    d.mkdir()
    (d / "good.csv").write_text("article_sku\nA\n")
    (d / "bad.csv").write_text("sku\nB\n")
    spec = JobSpec(source_type="csv", provider_name="p", required_fields=("article_sku",))
    res = run_job(spark, spec, str(d), str(tmp_path / "out"), kind="csv", level="contract")
    (d / "bad.csv").write_text("article_sku\nB\n")
    again = retry_quarantined(spark, spec, res.ledger_path, str(tmp_path / "out"), kind="csv", level="contract")
    assert {r[FILE] for r in again.ledger.collect()} == {"bad.csv"}
    rows = spark.read.parquet(res.clean_path).collect()
    assert sorted((r[FILE], r["article_sku"]) for r in rows) == [("bad.csv", "B"), ("good.csv", "A")]
    assert {r["status"]: r["files"] for r in run_status(spark.read.parquet(res.ledger_path)).collect()} == {"processed": 2}


def test_csv_quotes_line_breaks_and_missing_marks(spark, tmp_path):
    from tessera.sources.csv import read_csv
    (tmp_path / "q.csv").write_text('sku,say,n\nA,"He said ""hi"", ok",NA\nB,"two\nlines",null\nC,N/A,7\n')
    out = read_csv(spark, str(tmp_path / "q.csv"), JobSpec(source_type="csv", multiline=True))
    assert sorted((r["sku"], r["say"], r["n"]) for r in out.collect()) == [("A", 'He said "hi", ok', None), ("B", "two\nlines", None), ("C", None, "7")]


def test_folder_run_pairs_templates_and_companies(spark, tmp_path):
    import json

    from tessera.plans.job import run_folder
    for c, sku in (("acme", "sku"), ("beta", "code")):
        (tmp_path / "in" / c).mkdir(parents=True)
        (tmp_path / "in" / c / "jan.csv").write_text(f"{sku},amount\nA,1\n")
        (tmp_path / "in" / c / "jan.df-template.json").write_text(json.dumps(
            {"source_type": "csv", "column_mappings": {sku: "article_sku", "amount": "sales_amount"}, "provider_name": c}))
    (tmp_path / "in" / "none").mkdir()
    (tmp_path / "in" / "none" / "x.csv").write_text("a\n1\n")
    out = run_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(out) == 2
    rows = spark.read.parquet(str(tmp_path / "out" / "clean")).collect()
    assert sorted((r["company"], r["provider_id"], r["article_sku"], r["sales_amount"]) for r in rows) == [("acme", "acme", "A", 1.0), ("beta", "beta", "A", 1.0)]
    led = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out" / "ledger")).collect()
    assert sorted((r[FILE], r["status"]) for r in led) == [("jan.csv", "processed"), ("jan.csv", "processed"), ("x.csv", "skipped")]


def test_parquet_columns_of_all_files_and_widened_numbers(spark, tmp_path):
    from tessera.operators.combine import merge_frames, stack_by_name
    from tessera.operators.filters import apply_filters
    from tessera.operators.reshape import unpivot
    spark.createDataFrame([("A", 1.0)], "sku string, amount double").write.parquet(str(tmp_path / "in" / "a.parquet"))
    spark.createDataFrame([("B", "n")], "sku string, note string").write.parquet(str(tmp_path / "in" / "b.parquet"))
    paths = [str(tmp_path / "in" / "a.parquet"), str(tmp_path / "in" / "b.parquet")]
    res = run_job(spark, JobSpec(source_type="parquet", provider_name="p"), paths, str(tmp_path / "out"), kind="parquet")
    rows = spark.read.parquet(res.clean_path).collect()
    assert sorted((r["sku"], r["amount"], r["note"]) for r in rows) == [("A", 1.0, None), ("B", None, "n")]
    assert sorted(r[FILE] for r in res.ledger.collect()) == ["a.parquet", "b.parquet"]
    i, f = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(2, 2.5)], "k long, v double")
    assert dict(stack_by_name([i, f]).dtypes) == {"k": "bigint", "v": "double"}
    wide, _ = unpivot(spark.createDataFrame([(1, 2, 2.5)], "k int, a int, b double"), ["k"], "var", "val")
    assert dict(wide.dtypes)["val"] == "double"
    dotted = spark.createDataFrame([(1, "x"), (2, "y")], "`a.b` int, `c.d` string")
    assert apply_filters(dotted, [("a.b", ">", "1"), ("c.d", "=", "y")]).count() == 1
    assert merge_frames([dotted, dotted], ["a.b"], "outer").columns == ["a.b", "c.d", "c.d_2"]
