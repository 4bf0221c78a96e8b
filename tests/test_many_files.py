"""Folders of many unlike files: footers read by tasks, one scan per distinct schema."""

import contextlib
import io
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators.lineage import FILE
from tessera.plans.combine import run_combine, schema_groups
from tessera.sources.files import list_files
from tessera.sources.footers import file_footers, preflight_footers


def test_two_thousand_files_of_five_schemas(spark, tmp_path):
    kinds = [{"k": [1], "v": [2]}, {"k": [1], "t": ["x"]}, {"t": ["y"], "k": [1]}, {"k": [1], "v": ["z"]}, {"k": [1], "w": [0.5]}]
    for i in range(2000):
        pq.write_table(pa.table(kinds[i % 5] | {"k": [i]}), tmp_path / f"f{i:04d}.parquet")
    began = time.perf_counter()
    out = run_combine(spark, str(tmp_path), lineage=True)
    planned = time.perf_counter() - began
    assert planned < 120, planned
    assert out.columns == ["k", "v", FILE, "t", "w"] and dict(out.dtypes)["v"] == "string"
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("formatted")
    assert text.getvalue().split("(1) ")[0].count("Scan parquet") == 5
    want = Counter()
    for i in range(2000):
        row = {k: v[0] for k, v in (kinds[i % 5] | {"k": [i]}).items()}
        want[(i, None if "v" not in row else str(row["v"]), f"f{i:04d}.parquet", row.get("t"), row.get("w"))] += 1
    assert Counter(map(tuple, out.collect())) == want
    assert [len(paths) for _, paths in schema_groups(spark, str(tmp_path), [str(tmp_path)])] == [400] * 5


def test_strict_names_the_first_file_that_differs(spark, tmp_path):
    for i, cols in enumerate([{"a": [1], "b": [2]}, {"a": [1], "b": [2.5]}, {"b": [1], "a": [2]}]):
        pq.write_table(pa.table(cols), tmp_path / f"{i}.parquet")
    with pytest.raises(ValueError, match="2.parquet"):
        run_combine(spark, str(tmp_path), strict_schema=True)


def test_entries_that_are_folders(spark, tmp_path):
    """A folder whose parts differ is read part by part, one with partition folders keeps its partition column."""
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    pq.write_table(pa.table({"other": ["x"]}), tmp_path / "a.parquet" / "part-zz.parquet")
    spark.range(6).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(str(tmp_path / "b.parquet"))
    out = run_combine(spark, str(tmp_path))
    assert set(out.columns) == {"id", "other", "p"} and out.count() == 12
    assert out.where("p = 1").count() == 3 and out.where("other = 'x'").count() == 1


def test_footers_and_preflight(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, 2], "b": [[1], None], "c": [{"x": 1}, None]}), tmp_path / "full.parquet")
    pq.write_table(pa.table({"a": pa.array([], pa.int32())}), tmp_path / "empty.parquet")
    (tmp_path / "broken.parquet").write_text("no parquet")
    got = {r.path.rsplit("/", 1)[-1]: r for r in preflight_footers(list_files(spark, str(tmp_path))).collect()}
    assert (got["full.parquet"].rows, got["full.parquet"].columns, got["full.parquet"].status) == (2, 3, "OK")
    assert (got["empty.parquet"].rows, got["empty.parquet"].status) == (0, "Empty")
    assert got["broken.parquet"].status.startswith("error: ")
    for r in file_footers(list_files(spark, str(tmp_path))).where("message IS NULL").collect():
        from pyspark.sql.types import StructType
        import json
        assert spark.read.parquet(r.path).schema == StructType.fromJson(json.loads(r.schema))
    with pytest.raises(Exception):  # Spark's own reader names the file
        run_combine(spark, str(tmp_path)).collect()


def test_merge_mode_takes_all_inputs_at_once(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(k, f"{i}.{k}") for k in range(i, 6)], "k long, v string").write.parquet(str(tmp_path / f"{i}.parquet"))
    out = run_combine(spark, str(tmp_path), mode="merge", keys=["k"], how="outer")
    assert out.columns == ["k", "v", "v_2", "v_3", "v_4"]
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {k: tuple(f"{i}.{k}" if k >= i else None for i in range(4)) for k in range(6)}
