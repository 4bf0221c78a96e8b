"""Previews that read no more of a file than the rows they show."""

from pyspark.sql import functions as F

from tessera.operators.lineage import FILE
from tessera.sources.csv import preview
from tessera.sources.files import list_files
from tessera.sources.heads import STEP, file_heads, first_records, preview_files
from tessera.spec import HeaderCell, JobSpec


def test_bytes_read_do_not_grow_with_the_file(tmp_path):
    sizes = {}
    for lines in (1_000, 100_000, 1_000_000):
        path = tmp_path / f"{lines}.csv"
        path.write_text("a,b\n" + "1,some text\n" * lines)
        with open(path, "rb") as f:
            records, sizes[lines] = first_records(f, 11)
        assert records == [["a", "b"]] + [["1", "some text"]] * 10
    assert max(sizes.values()) <= STEP < (tmp_path / "1000000.csv").stat().st_size


def test_same_rows_as_a_full_scan(spark, tmp_path):
    d = tmp_path / "in"
    (d / "x").mkdir(parents=True)
    (d / "a.csv").write_text('skip\nk,v,w\n1,"a, ""b""",\n2,NA,x\n\n3,c,y\n4,d,z\n')
    (d / "x" / "b.csv").write_text("skip\nw,k\nq,7\n")
    (d / "empty.csv").write_text("")
    for spec in (JobSpec(source_type="csv", skiprows=(0,)), JobSpec(source_type="csv", header_row=1), JobSpec(source_type="csv", skiprows=(0, 3)),
                 JobSpec(source_type="csv", skiprows=(0,), column_mappings={"k": "order_id"}, columns=("k",)),
                 JobSpec(source_type="csv", skiprows=(0,), headers=(HeaderCell("first", 0, 0), HeaderCell("third", 2, 0)))):
        for n in (1, 3, 50):
            got, want = preview_files(list_files(spark, str(d)), spec, n), preview(spark, str(d), spec, n)
            cols = [c for c in want.columns if not c.startswith("__")]
            rows = lambda df: sorted(map(repr, df.select(cols).collect()))
            assert rows(got) == rows(want), (spec, n)


def test_many_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03d}.csv").write_text("a\n" + f"{i}\n" * 50)
    out = file_heads(list_files(spark, str(tmp_path)), 3)
    assert out.count() == 900 and out.where(F.col("row") == 2).select(FILE).distinct().count() == 300
