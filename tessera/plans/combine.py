"""Combine the outputs in a folder (stack or key merge), files in sorted order."""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.combine import stack_by_name, stack_strict
from ..operators.lineage import FILE
from ..operators.merge import merge_many
from ..session import checkpointed
from ..sources.footers import file_footers


def matching_files(spark: SparkSession, input_dir: str, pattern: str = "*.parquet") -> list[str]:
    """Sorted entries directly under ``input_dir`` whose name matches ``pattern``.

    An entry is a file or a folder written by Spark (``out.parquet/part-…``). Only the distinct
    entry names reach the driver.
    """
    root = input_dir.rstrip("/")
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
               .select("path"))
    rel = F.regexp_replace("path", r"^(file:)?" + _re_escape(root.replace("file:", "")) + "/", "")
    tops = [r["top"] for r in listing.select(F.split(rel, "/")[0].alias("top")).distinct().collect()]
    return sorted(f"{root}/{t}" for t in tops if fnmatch.fnmatch(t, pattern))


def _re_escape(text: str) -> str:
    import re
    return re.escape(text)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def schema_groups(spark: SparkSession, root: str, entries: list[str]) -> list[tuple[str | None, list[str]]] | None:
    """(schema as JSON, paths) by distinct schema, in order of the first entry that has it; a folder whose files differ is listed file by
    file, a folder with partition folders alone and without a schema. None where footers cannot be read.

    Footers are read by tasks; the driver gets one row per entry.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(entries).select("path")
    rel = F.regexp_replace("path", r"^(file:)?/*" + _re_escape(root.replace("file:", "").lstrip("/")) + "/", "")
    feet = checkpointed(file_footers(files).withColumn("rel", rel).withColumn("entry", F.split("rel", "/")[0]))
    if not feet.where("message IS NOT NULL").isEmpty():
        return None
    shape = feet.groupBy("entry").agg(F.count_distinct("schema").alias("n"), F.min("schema").alias("schema"), F.max(F.contains("rel", F.lit("="))).alias("parts"))
    groups: dict = {}
    for r in shape.orderBy("entry").collect():
        if r["parts"]:
            groups[r["entry"]] = (None, [f"{root}/{r['entry']}"])
        elif r["n"] == 1:
            groups.setdefault(r["schema"], (r["schema"], []))[1].append(f"{root}/{r['entry']}")
        else:
            for f in feet.where(F.col("entry") == r["entry"]).orderBy("path").select("path", "schema").toLocalIterator():
                groups.setdefault(f["schema"], (f["schema"], []))[1].append(f["path"])
    return list(groups.values())


def _read_groups(spark, root, entries, lineage):
    """One scan per distinct schema, with the first path of each."""
    groups = schema_groups(spark, root, entries)
    if groups is None:
        return None
    frames = []
    for schema, paths in groups:
        reader = spark.read.schema(StructType.fromJson(json.loads(schema))) if schema else spark.read
        df = reader.parquet(*paths)
        if lineage:   # the entry under the folder that the row came from
            df = df.withColumn(FILE, F.regexp_extract(F.col("_metadata.file_path"), _re_escape(root.rstrip("/").replace("file:", "")) + "/([^/]+)", 1))
        frames.append(df)
    return frames, [paths[0].rsplit("/", 1)[-1] for _, paths in groups]


def run_combine(spark: SparkSession, input_dir: str, pattern: str = "*.parquet", mode: str = "concat",
                keys=None, how: str = "inner", strict_schema: bool = False, lineage: bool = False) -> DataFrame:
    """Stack (``concat``) or merge the matching files; no file is an error.

    Parquet files are stacked by one scan per distinct schema, whatever their number; merges are one exchange over all
    inputs (``merge_many``). The names of the entries are the only thing the driver handles.
    """
    paths = matching_files(spark, input_dir, pattern)
    if not paths:
        raise FileNotFoundError(f"No files found in {input_dir} with pattern {pattern}")
    grouped = None
    if mode == "concat" and all(p.lower().endswith(".parquet") for p in paths):
        grouped = _read_groups(spark, input_dir, paths, lineage)
    if grouped:
        frames, labels = grouped
    else:
        frames, labels = [read_output(spark, p) for p in paths], [p.rsplit("/", 1)[-1] for p in paths]
        if lineage:
            frames = [f.withColumn(FILE, F.lit(label)) for f, label in zip(frames, labels)]
    if mode == "concat":
        return stack_strict(frames, labels) if strict_schema else stack_by_name(frames)
    return merge_many(frames, list(keys or []), how)
