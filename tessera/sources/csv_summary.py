"""S1 in two reads: one that sums every block of every file up, one for the job itself. A pass over the lines, which parses nothing, tells the
width before them where the spec does not.

The summary of a block holds its record count and width, its first records (header and skipped rows lie there) and, per column position, how
many cells are there, are numbers, are whole numbers. Summaries merge by addition, so record numbers, header layouts and number types of
all files follow from them: what the header and skipped rows added is taken off again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import to_num
from ..operators.lineage import FILE, KEY, LINEAGE, qc
from ..spec import JobSpec
from .rows import _column_names, _kept, apply_header, infer_types

# Shapes of usual numbers. Their digits fit a double, so the shape alone tells whole numbers; all other texts are parsed.
PLAIN_WHOLE, PLAIN_DECIMAL, NO_FRACTION = r"^[+-]?[0-9]{1,15}\z", r"^[+-]?[0-9]{1,9}\.[0-9]{1,6}\z", r"\.0+\z"

_BLOCK = pa.schema([("__path", pa.string()), (FILE, pa.string()), ("__blk", pa.int64()), ("m0", pa.int64()), ("n", pa.int64()), ("over", pa.int32()),
                    ("head", pa.list_(pa.list_(pa.string()))), *[(c, pa.list_(pa.int64())) for c in ("cells", "numbers", "whole")]])
BLOCKS = f"__path string, {FILE} string, __blk long, m0 long, n long, over int, head array<array<string>>, cells array<long>, numbers array<long>, whole array<long>"


def _kinds(vals):
    """Per cell 0 (missing), 1 (text), 2 (a number) or 3 (a whole one)."""
    from .csv import NULL_MARKS

    def kind(v):
        x = to_num(v)
        plain = F.when(v.isNull(), 0).when(v.rlike(PLAIN_WHOLE), 3).when(v.rlike(PLAIN_DECIMAL), F.when(v.rlike(NO_FRACTION), 3).otherwise(2))
        return plain.when(v.isin(*NULL_MARKS), 0).when(x.isNull(), 1).when(x == F.floor(x), 3).otherwise(2).cast("tinyint")
    return F.transform(vals, kind)


def _read(spark: SparkSession, paths, spec: JobSpec, width: int, corrupt: bool = False) -> DataFrame:
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)] + [StructField("__raw", StringType())] * corrupt)
    reader = (spark.read.schema(schema).option("header", False).option("sep", spec.delimiter).option("encoding", spec.encoding)
              .option("multiLine", spec.multiline).option("mode", "PERMISSIVE").option("escape", '"').option("recursiveFileLookup", True))
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", "__raw")
    return reader.csv(paths).select(
        F.col("_metadata.file_path").alias(KEY), F.col("_metadata.file_name").alias(FILE), F.col("_metadata.file_block_start").alias("__blk"),
        F.monotonically_increasing_id().alias("__mid"), F.array(*[F.col(f"_c{i}") for i in range(width)]).alias("vals"),
        # a record with more cells than the schema comes with its text; its delimiters bound how many
        (F.coalesce(F.size(F.split("__raw", re.escape(spec.delimiter), -1)), F.lit(0)) if corrupt else F.lit(0)).cast("int").alias("over"))


def _summed(keep: int):
    def run(batches):
        held = None

        def done():
            if held:
                yield pa.RecordBatch.from_pylist([held | {c: v.tolist() for c, v in held.items() if isinstance(v, np.ndarray)}], _BLOCK)

        for batch in batches:
            path, block = batch.column(KEY), np.asarray(batch.column("__blk"))
            names = path.to_pylist()
            cut = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1] or block[i] != block[i - 1]], len(names)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                kinds = np.asarray(part.column("kinds").flatten()).reshape(b - a, -1)
                if held is None or (held["__path"], held["__blk"]) != (names[a], int(block[a])):
                    yield from done()
                    zero = np.zeros(kinds.shape[1], np.int64)
                    held = {"__path": names[a], FILE: part.column(FILE)[0].as_py(), "__blk": int(block[a]), "m0": part.column("__mid")[0].as_py(), "n": 0,
                            "over": 0, "head": [], "cells": zero, "numbers": zero, "whole": zero}
                if len(held["head"]) < keep:
                    held["head"] += part.column("vals").slice(0, keep - len(held["head"])).to_pylist()
                held["n"] += b - a
                held["over"] = max(held["over"], int(np.asarray(part.column("over")).max()))
                for c, least in (("cells", 1), ("numbers", 2), ("whole", 3)):
                    held[c] = held[c] + (kinds >= least).sum(axis=0)
        yield from done()
    return run


def _widest_line(spark: SparkSession, paths, spec: JobSpec) -> int:
    """Most delimiters on one line, plus one."""
    lines = spark.read.option("recursiveFileLookup", True).option("encoding", spec.encoding).text(paths)
    found = F.length("value") - F.length(F.replace("value", F.lit(spec.delimiter)))
    return int(lines.agg(F.max(found)).first()[0] or 0) // len(spec.delimiter) + 1


def summarise(spark: SparkSession, paths, spec: JobSpec, width: int | None = None) -> tuple[DataFrame, int, int]:
    """(blocks, width, header): a row per file block, the width of records, and the index of the header row among all records. One read after
    the widest line is known; a second one where records are wider still, as those of several lines or in other encodings may be."""
    skip = set(spec.skiprows)
    header = [i for i in range(int(spec.header_row) + len(skip) + 1) if i not in skip][int(spec.header_row)]
    known = width or spec.csv_width
    exact = known or not spec.multiline and spec.encoding.lower() in ("utf-8", "utf8")     # no record is wider than the widest line
    width = known or _widest_line(spark, paths, spec)
    while True:
        raw = _read(spark, paths, spec, width, corrupt=not exact)
        raw = raw.select("*", _kinds(F.col("vals")).alias("kinds"))
        blocks = _kept(raw.mapInArrow(_summed(max([header, *skip]) + 1), BLOCKS), "csv-blocks")
        over = blocks.agg(F.max("over")).first()[0] or 0
        if exact or over <= width:
            return blocks, width, header
        width = over


def _numbered(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("off", F.coalesce(F.sum("n").over(w), F.lit(0)))


def read_csv_typed(spark: SparkSession, paths, spec: JobSpec, width: int | None = None, exclude=()) -> DataFrame:
    """``read_csv`` and ``infer_types`` out of one summary: the result reads each file once more. The second read must cut files into the same
    blocks as the first (the same session settings); where it does not, it fails rather than number records wrongly."""
    from ..operators.project import filter_and_rename, layout_names
    from .csv import NULL_MARKS

    paths = [paths] if isinstance(paths, str) else list(paths)
    blocks, width, header = summarise(spark, paths, spec, width)
    blocks = _kept(_numbered(blocks), "csv-offsets")
    skip = sorted(set(spec.skiprows))
    first = blocks.select(KEY, FILE, "off", F.posexplode("head").alias("j", "vals")).withColumn("i", F.col("off") + F.col("j"))
    heads = first.where(F.col("i") == header).select(KEY, FILE, F.col("vals").alias("names"))

    at = F.col("__mid") - F.col("m0")
    i = F.when((at >= 0) & (at < F.col("n")), F.col("off") + at).otherwise(F.raise_error(F.lit("CSV blocks differ from those of the summary")))
    raw = _read(spark, paths, spec, width).join(blocks.select(F.col(KEY).alias("__p"), F.col("__blk").alias("__b"), "m0", "n", "off"),
                                                (F.col(KEY) == F.col("__p")) & (F.col("__blk") == F.col("__b")), "left")
    raw = raw.withColumn("i", F.coalesce(i, F.raise_error(F.lit("CSV blocks differ from those of the summary")).cast("long")))
    row = F.col("i") - sum(((F.col("i") > s).cast("long") for s in skip), F.lit(0))
    rows = raw.where(~F.col("i").isin(skip)) if skip else raw
    frame, _ = apply_header(rows.select(FILE, KEY, row.alias("row"), "vals"), spec, heads=heads,
                            shown=None if spec.headers else lambda own, columns: layout_names(own, spec, columns))
    data = [c for c in frame.columns if c not in LINEAGE]
    frame = frame.withColumns({c: F.when(~qc(c).isin(*NULL_MARKS), qc(c)) for c in data}) if data else frame
    frame = frame if spec.headers else filter_and_rename(frame, spec, layout=False)

    none = (F.col("i") <= header) | F.col("i").isin(skip) if skip else F.col("i") <= header
    count = lambda kinds, least: F.transform(kinds, lambda k: -(k >= least).cast("long"))
    off = first.where(none).select(KEY, FILE, _kinds(F.col("vals")).alias("k"))
    off = off.select(KEY, FILE, *[count(F.col("k"), n).alias(c) for c, n in (("cells", 1), ("numbers", 2), ("whole", 3))])
    cells = blocks.select(KEY, FILE, "cells", "numbers", "whole").unionByName(off)
    cells = cells.select(KEY, FILE, F.posexplode(F.arrays_zip("cells", "numbers", "whole")).alias("at", "c"))
    stats = cells.groupBy(KEY, FILE, "at").agg(*[F.sum(f"c.{c}").alias(c) for c in ("cells", "numbers", "whole")])
    if spec.headers:
        targets = [F.struct(F.lit(h.column).alias("at"), F.lit(h.alias or spec.column_mappings.get(h.name, h.name)).alias("column")) for h in spec.headers]
        places = F.array(*targets)
        stats = stats.select("*", F.explode(F.filter(F.transform(places, lambda p: F.when(p["at"] == F.col("at"), p["column"])), lambda c: c.isNotNull())).alias("column"))
    else:
        named = heads.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("__layout", F.xxhash64("names"))
        columns = named.select("__layout", "names").distinct().mapInArrow(_column_names, "__layout long, names array<string>, columns array<string>")
        named = named.select(KEY, "__layout").join(columns.select("__layout", "columns"), "__layout").select(KEY, F.posexplode("columns").alias("at", "name"))
        to = F.create_map(*[F.lit(x) for kv in spec.column_mappings.items() for x in kv]) if spec.column_mappings else None
        column = F.coalesce(F.try_element_at(to, F.col("name")), F.col("name")) if to is not None else F.col("name")
        stats = stats.join(named.select(KEY, "at", column.alias("column")), [KEY, "at"])
    return infer_types(frame, exclude, stats=stats)
