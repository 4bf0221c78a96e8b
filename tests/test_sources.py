"""Scans: workbooks, CSV, mislabelled files, folder listing and spec pairing."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.lineage import FILE, SHEET
from tessera.sources import csv as csvsrc
from tessera.sources import files as filesrc
from tessera.sources import workbook as wb
from tessera.sources.rows import apply_header, header_row_guess_rows
from tessera.spec import JobSpec
from xlsx_writer import write_samples, write_xlsx, grid

EXPECTED = {
    ("multi_sheet_jan.xlsx", "Orders"): (["order_id", "region", "product", "quantity", "unit_price"], None),
    ("multi_sheet_jan.xlsx", "Adjustments"): (["order_id", "adjustment", "amount"], None),
    ("consistent_schema_feb.xlsx", "Orders"): (["order_id", "region", "product", "quantity", "unit_price"], None),
    ("offset_header.xlsx", "Departments"): (["department", "owner", "active", "budget"], 3),
    ("merged_header.xlsx", "Sales"): (["Jan", "Feb", "Mar"], None),
    ("split_year_month.xlsx", "Split"): (["SKU", "2020", "2021"], None),
}


@pytest.fixture(scope="module")
def samples(tmp_path_factory):
    root = tmp_path_factory.mktemp("samples")
    write_samples(root)
    return root


@pytest.fixture(scope="module")
def decoded(spark, samples):
    return wb.decode(spark, str(samples))


def test_sheet_listing(decoded):
    got = {(r[FILE], r["sheet"], r["position"]) for r in wb.sheet_list(decoded).collect()}
    assert ("multi_sheet_jan.xlsx", "Adjustments", 1) in got and len(got) == 6


@pytest.mark.parametrize("key", sorted(EXPECTED))
def test_golden_headers(decoded, key):
    fname, sheet = key
    headers, header_row = EXPECTED[key]
    spec = JobSpec(sheet=sheet)
    rows = wb.sheet_rows(decoded, spec).where(F.col(FILE) == fname)
    guess = header_row_guess_rows(rows, max_rows=12)
    got_row = guess.collect()[0]["header_row"]
    names = wb.merged_header_names(decoded, rows, guess, spec).collect()
    if names:
        hdr = names[0]["names"]
    else:
        hdr = rows.where(F.col("row") == got_row).collect()[0]["vals"]
    hdr = [h for h in hdr if h is not None and str(h).strip()]
    assert sorted(hdr) == sorted(headers)
    if header_row is not None:
        assert got_row == header_row


def test_merged_header_expansion(spark, tmp_path):
    cells = grid(["x", None, None, "y"], [[1, 2, 3, 4]], start=1)
    cells[(0, 0)] = "Total"
    write_xlsx(tmp_path / "m.xlsx", {"S": cells}, {"S": ["A1:B1", "B2:C2"]})
    dec = wb.decode(spark, str(tmp_path / "m.xlsx"))
    spec = JobSpec(sheet="S", header_row=1)
    frame = wb.read_workbooks(spark, None, spec, decoded=dec)
    assert frame.columns[:4] == ["x", "merged_B2_B", "merged_B2_C", "y"]
    spec0 = JobSpec(sheet="S", header_row=0)
    frame0 = wb.read_workbooks(spark, None, spec0, decoded=dec)
    assert frame0.columns[:2] == ["Total", "Total"] or frame0.columns[:2] == ["Total", "Total.1"]


def test_multi_sheet_stack(spark, samples):
    spec = JobSpec.from_dict({"sheets": ["Orders", "Adjustments"], "header_row": 0})
    frame = wb.read_workbooks(spark, str(samples / "multi_sheet_jan.xlsx"), spec)
    rows = frame.collect()
    assert len(rows) == 4
    assert set(frame.columns) >= {"order_id", "region", "adjustment", "amount", SHEET, FILE}
    assert {r[SHEET] for r in rows} == {"Orders", "Adjustments"}


def test_workbook_with_spec_and_types(spark, samples):
    spec = JobSpec(sheet="Departments", header_row=3, columns=("department", "budget", "active"),
                   column_mappings={"budget": "sales_amount"})
    frame = wb.read_workbooks(spark, str(samples / "offset_header.xlsx"), spec)
    assert frame.columns[:3] == ["department", "sales_amount", "active"]
    got = sorted((r["department"], r["sales_amount"], r["active"]) for r in frame.collect())
    assert got == [("Finance", "125000", "True"), ("Marketing", "98000", "True")]


def test_corrupt_and_mislabelled(spark, tmp_path):
    (tmp_path / "fake.xlsx").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04garbage")
    dec = wb.decode(spark, str(tmp_path))
    assert wb.sheet_list(dec).count() == 0
    errs = {r[FILE]: r["rtype"] for r in wb.decode_errors(dec).collect()}
    assert errs == {"fake.xlsx": "not_zip", "broken.xlsx": "error"}
    # The mislabelled file reads as CSV
    frame = csvsrc.read_csv(spark, str(tmp_path / "fake.xlsx"), JobSpec(source_type="csv"))
    assert sorted((r["a"], r["b"]) for r in frame.collect()) == [("1", "2"), ("3", "4")]


def test_csv_header_row_and_skiprows(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_text("Report;;\nskip me;;\nsku;qty;amount\nA;1;1 000,5\nB;2;3\n")
    (d / "b.csv").write_text("Report;;\nskip me;;\nsku;amount;qty\nC;7;3\n")
    spec = JobSpec(source_type="csv", delimiter=";", header_row=1, skiprows=(1,))
    frame = csvsrc.read_csv(spark, str(d), spec)
    got = sorted((r[FILE], r["sku"], r["qty"], r["amount"]) for r in frame.collect())
    assert got == [("a.csv", "A", "1", "1 000,5"), ("a.csv", "B", "2", "3"), ("b.csv", "C", "3", "7")]
    guessed = csvsrc.read_csv(spark, str(d), JobSpec(source_type="csv", delimiter=";"), guess_header=True)
    assert set(guessed.columns) >= {"sku", "qty", "amount"} and guessed.count() == 3


def test_csv_row_order_across_blocks(spark, tmp_path):
    """Record numbering stays exact when a file is split into many blocks."""
    p = tmp_path / "big.csv"
    p.write_text("".join(f"{i},row{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = csvsrc.read_csv_rows(spark, str(p), width=2)
        got = [(r["row"], r["vals"][0]) for r in rows.collect()]
        n_blocks = rows.select("__path").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 20000
    assert all(int(v) == r for r, v in got)


def test_listing_company_and_pairing(spark, tmp_path):
    root = tmp_path / "in"
    (root / "acme").mkdir(parents=True)
    (root / "acme" / "jan.csv").write_text("a\n1\n")
    (root / "acme" / "feb.csv").write_text("a\n1\n")
    (root / "acme" / "jan.df-template.json").write_text(json.dumps({"source_type": "csv"}))
    (root / "acme" / "zz.df-template.yaml").write_text("source_type: csv\n")
    (root / "top.csv").write_text("a\n1\n")
    listing = filesrc.list_files(spark, str(root))
    rows = {r[FILE]: r for r in listing.collect()}
    assert rows["jan.csv"]["company"] == "acme" and rows["top.csv"]["company"] is None
    paired = {r[FILE]: r["spec_path"] for r in filesrc.pair_specs(listing).collect()}
    assert paired["jan.csv"].endswith("jan.df-template.json")
    assert paired["feb.csv"].endswith("jan.df-template.json")
    assert paired["top.csv"] is None


def test_metadata_headers(spark, tmp_path):
    from tessera.sources.rows import apply_metadata_headers
    from tessera.spec import HeaderCell
    p = tmp_path / "meta.csv"
    p.write_text("Sales Report Q1,,,\n,Product Code,Qty,Amount\nx,A1,3,9.5\ny,B2,4,1.0\n")
    rows = csvsrc.read_csv_rows(spark, str(p))
    cells = [HeaderCell("Sales Report Q1", 0, 0, is_metadata=True), HeaderCell("Product Code", 1, 1),
             HeaderCell("Qty", 2, 1), HeaderCell("Amount", 3, 1), HeaderCell("dup", 1, 1)]
    out = apply_metadata_headers(rows, cells)
    assert out.columns[:4] == ["Sales Report Q1", "Product Code", "Qty", "Amount"]
    assert sorted(tuple(r)[:4] for r in out.collect()) == [("x", "A1", "3", "9.5"), ("y", "B2", "4", "1.0")]


def test_header_map_text_and_rows(spark, tmp_path):
    from tessera.operators.project import apply_header_map, header_map_rows, parse_header_map_text
    text = "# comment\nSKU -> article_sku\nAmount: sales_amount  # trailing\n\nbroken line\n"
    assert parse_header_map_text(text) == {"SKU": "article_sku", "Amount": "sales_amount"}
    (tmp_path / "map.txt").write_text(text)
    rows = {(r["source"], r["target"]) for r in header_map_rows(spark.read.text(str(tmp_path / "map.txt"))).collect()}
    assert rows == {("SKU", "article_sku"), ("Amount", "sales_amount")}
    df = spark.createDataFrame([("a", 1.0)], "sku string, AMOUNT double")
    assert apply_header_map(df, parse_header_map_text(text)).columns == ["article_sku", "sales_amount"]


def test_missing_key_report_and_check():
    from tessera.operators.combine import missing_key_report
    rows = missing_key_report({"a.parquet": ["k1", "x"], "b.parquet": ["k1", "k2"]}, ["k1", "k2"])
    assert rows == [{"file": "a.parquet", "missing": ["k2"], "message": "a.parquet: missing k2"}]


def test_jdbc_options():
    from tessera.sources.jdbc import Connection
    c = Connection("erp", "postgresql", "db.example", 5433, "sales", user="u", password="p")
    assert c.reader_options() == {"url": "jdbc:postgresql://db.example:5433/sales", "user": "u", "password": "p"}
    assert Connection("x", url="jdbc:sqlite:/tmp/a.db").jdbc_url() == "jdbc:sqlite:/tmp/a.db"


def test_csv_width_from_spec(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("a;b\n1;2\n")
    spec = JobSpec.from_dict({"source_type": "csv", "delimiter": ";", "csv_width": 2})
    assert spec.csv_width == 2
    frame = csvsrc.read_csv(spark, str(p), spec)
    assert [(r["a"], r["b"]) for r in frame.collect()] == [("1", "2")]


def test_csv_row_order_many_files_packed(spark, tmp_path):
    """Several files, each cut into many blocks, with blocks of different files sharing a task."""
    d = tmp_path / "many"
    d.mkdir()
    sizes = {"a.csv": 7000, "b.csv": 3000, "c.csv": 11000}
    for name, n in sizes.items():
        (d / name).write_text("".join(f"{i},{name}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = csvsrc.read_csv_rows(spark, str(d), width=2)
        got = [(r[FILE], r["row"], r["vals"][0]) for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == sum(sizes.values())
    assert all(int(v) == r for _, r, v in got)
    for name, n in sizes.items():
        assert sorted(r for f, r, _ in got if f == name) == list(range(n))
