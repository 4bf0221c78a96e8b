"""Header layouts, record numbers and number types out of one summary of all files: the same frame as reading them one by one gives."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.lineage import FILE, LAYOUT, NUMERIC, ORD
from tessera.sources import csv_summary
from tessera.sources.csv import read_csv
from tessera.sources.csv_summary import read_csv_typed, summarise
from tessera.sources.rows import infer_types
from tessera.spec import HeaderCell, JobSpec


def same(spark, paths, spec, exclude=()):
    got = read_csv_typed(spark, paths, spec, exclude=exclude)
    want = infer_types(read_csv(spark, paths, spec), exclude)
    assert dict(got.dtypes) == dict(want.dtypes)
    rows = lambda df: sorted(repr([r[c] if c != NUMERIC else sorted(r[c] or []) for c in want.columns]) for r in df.collect())
    assert rows(got) == rows(want)
    return got


def corpus(d):
    d.mkdir()
    (d / "a.csv").write_text("id,qty,amount,note\n1,2,1.5,x\n2,NA,2,\n3,4,,7\n")
    (d / "b.csv").write_text("amount,id,extra\n1,5,yes\nn/a,6,no\n")
    (d / "c.csv").write_text("id,qty\nx1,3\n")
    (d / "only_header.csv").write_text("id,qty,late\n")
    (d / "empty.csv").write_text("")
    return str(d)


@pytest.mark.parametrize("spec", [
    JobSpec(source_type="csv"), JobSpec(source_type="csv", column_mappings={"id": "order_id", "amount": "sales_amount"}, columns=("id", "amount", "qty")),
    JobSpec(source_type="csv", header_row=1), JobSpec(source_type="csv", skiprows=(1,)), JobSpec(source_type="csv", skiprows=(0, 2)),
    JobSpec(source_type="csv", csv_width=4),
    JobSpec(source_type="csv", headers=(HeaderCell("qty", 1, 0), HeaderCell("id", 0, 0, alias="key")))])
def test_same_as_separate_passes(spark, tmp_path, spec):
    same(spark, corpus(tmp_path / "in"), spec)
    same(spark, corpus(tmp_path / "in2"), spec, exclude={"qty"})


def test_quotes_semicolons_and_line_breaks(spark, tmp_path):
    d = tmp_path / "q"
    d.mkdir()
    (d / "a.csv").write_text('k;v;t\n1;"1;5";"say ""x"""\n2;3;\n')
    same(spark, str(d), JobSpec(source_type="csv", delimiter=";"))
    m = tmp_path / "m"
    m.mkdir()
    (m / "a.csv").write_text('k,v\n1,"two\nlines"\n2,x\n')
    same(spark, str(m), JobSpec(source_type="csv", multiline=True, csv_width=2))


def test_files_of_many_small_blocks(spark, tmp_path):
    d = tmp_path / "blocks"
    d.mkdir()
    r = random.Random(4)
    for f in "abc":
        (d / f"{f}.csv").write_text("skip me\nn,v\n" + "".join(f"{i},{r.choice(['1', '2.5', 'NA'])}\n" for i in range(9000)))
    spec = JobSpec(source_type="csv", skiprows=(0,))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        out = read_csv_typed(spark, str(d), spec)
        assert out.count() == 27_000 and dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["v"] == "double"
        assert out.where(F.col("n") != F.col(f"{ORD}.i") - 1).isEmpty()  # record numbers count the header row
        other = read_csv_typed(spark, str(d), spec)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match="blocks differ"):
        other.select(F.sum(f"{ORD}.i")).collect()  # cut into other blocks than those of the summary


def test_a_wide_corpus_is_read_twice(spark, tmp_path, monkeypatch):
    """40 files of 120 columns and five layouts: one read for the summary, one for the result."""
    d = tmp_path / "wide"
    d.mkdir()
    r = random.Random(9)
    for f in range(40):
        names = [f"c{(i * (f % 5 + 1)) % 121}" for i in range(1, 121)]
        rows = [[str(r.randrange(9)) if i % 3 else f"t{r.randrange(9)}" for i in range(120)] for _ in range(5)]
        (d / f"f{f:02d}.csv").write_text("\n".join(",".join(x) for x in [names, *rows]) + "\n")
    reads = []
    real = csv_summary._read
    monkeypatch.setattr(csv_summary, "_read", lambda *a, **kw: reads.append(1) or real(*a, **kw))
    out = read_csv_typed(spark, str(d), JobSpec(source_type="csv"))
    assert len(reads) == 2 and len([c for c in out.columns if c.startswith("c")]) == 120
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("formatted")
    assert text.getvalue().split("(1) ")[0].lower().count("scan csv") == 1
    assert out.count() == 200 and LAYOUT in out.columns and NUMERIC in out.columns
    one = out.where(F.col(FILE) == "f00.csv").limit(1).first()
    assert "c2" in one[NUMERIC] and "c1" not in one[NUMERIC]


def test_records_wider_than_the_first_lines(spark, tmp_path):
    d = tmp_path / "grow"
    d.mkdir()
    (d / "a.csv").write_text("a,b\n" + "1,2\n" * 500)
    (d / "b.csv").write_text("a,b,c,d,e\n1,2,3,4,5\n")
    blocks, width, header = summarise(spark, [str(d / "a.csv"), str(d / "b.csv")], JobSpec(source_type="csv"))
    assert (width, header) == (5, 0) and blocks.agg(F.sum("n")).first()[0] == 503
    same(spark, str(d), JobSpec(source_type="csv"))


def test_one_summary_where_the_first_lines_are_narrow(spark, tmp_path, monkeypatch):
    d = tmp_path / "narrow"
    d.mkdir()
    (d / "a.csv").write_text("k,v\n" + "".join(f"{i},{i}\n" for i in range(500)))
    (d / "b.csv").write_text('k,v,w,x\n1,2,3,4\n5,"1,234,567.5",,\n')
    reads, real = [], csv_summary._read
    monkeypatch.setattr(csv_summary, "_read", lambda *a, **kw: reads.append(1) or real(*a, **kw))
    read_csv_typed(spark, str(d), JobSpec(source_type="csv")).collect()
    assert len(reads) == 2                     # the summary and the result
    same(spark, str(d), JobSpec(source_type="csv", columns=("w", "v"), column_mappings={"v": "value"}))


def test_kinds_by_shape_are_those_of_parsed_numbers(spark):
    from tessera.functions import to_num
    from tessera.sources.csv import NULL_MARKS

    rng = random.Random(5)
    texts = [*NULL_MARKS, None, "0", "-0", "+7", "1.0", "1.", ".5", "-3.25", "999999999.000001", "999999999.0000001", "9" * 15, "9" * 16, "9" * 400, "1e3", "1e-3", "1.50\n",
             "5\n", " 5", "5 ", "inf", "-Infinity", "1d", "1,5", "--1", "\u0661", "1.0.0"]
    texts += ["".join(rng.choice("0123456789.+-e ") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    x = to_num(F.col("t"))
    slow = F.when(F.col("t").isNull() | F.col("t").isin(*NULL_MARKS), 0).when(x.isNull(), 1).when(x == F.floor(x), 3).otherwise(2)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", csv_summary._kinds(F.array("t"))[0].alias("got"), slow.alias("want"))
    assert [r for r in df.collect() if r["got"] != r["want"]] == []
