"""Header-less CSV scans with per-file record order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import to_num
from ..operators.lineage import FILE, KEY, LINEAGE, qc
from ..spec import JobSpec
from .rows import apply_header, drop_skipped, header_row_guess_rows


def csv_width(spark: SparkSession, paths, delimiter: str = ",", encoding: str = "utf-8") -> int:
    """Upper bound of the record width: most delimiters on one line, plus one (one text pass)."""
    import re
    read = spark.read.option("recursiveFileLookup", True)
    lines = read.option("encoding", encoding).text(paths) if encoding.lower() in ("utf-8", "utf8") \
        else read.option("lineSep", "\n").text(paths)
    w = lines.agg(F.max(F.size(F.split("value", re.escape(delimiter), -1)))).first()[0]
    return int(w or 1)


# Texts that a typed reader takes for a missing value.
NULL_MARKS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
              "NaN", "None", "n/a", "nan", "null")


def read_csv_rows(spark: SparkSession, paths, delimiter: str = ",", encoding: str = "utf-8",
                  width: int | None = None, multiline: bool = False) -> DataFrame:
    """Row table of CSV records: ``source_file, __path, row, vals, w`` (cells as text).

    Record order per file is rebuilt without one task per file: each split (file block) numbers
    its records with ``monotonically_increasing_id`` (contiguous inside a split), a small
    aggregate gives each block's record count, a running sum over the blocks of a file gives its
    offset. The offsets table has one row per block; the planner picks the join by its size. ``w`` is the
    number of cells up to the last filled one, as ``vals`` is padded to the widest file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    width = width or csv_width(spark, paths, delimiter, encoding)
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
    raw = (spark.read.schema(schema)
           .option("header", False).option("sep", delimiter).option("encoding", encoding)
           .option("multiLine", multiline).option("mode", "PERMISSIVE").option("escape", '"').option("recursiveFileLookup", True)
           .csv(paths))
    raw = raw.select(
        F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias(FILE),
        F.col("_metadata.file_block_start").alias("__blk"), F.monotonically_increasing_id().alias("__mid"),
        F.array(*[F.col(f"_c{i}") for i in range(width)]).alias("vals"),
        F.greatest(F.lit(0), *[F.when(F.col(f"_c{i}").isNotNull(), i + 1) for i in range(width)]).alias("w"))
    blocks = raw.groupBy("__path", "__blk").agg(F.min("__mid").alias("__m0"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__path").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return raw.join(offsets, ["__path", "__blk"]).select(
        FILE, KEY, (F.col("__off") + F.col("__mid") - F.col("__m0")).alias("row"), "vals", "w")


def with_text_kinds(rows: DataFrame) -> DataFrame:
    """Cell kinds of text cells: ``number`` when the text parses as a number, else ``text``."""
    kinds = F.transform("vals", lambda v: F.when(v.isNull(), F.lit(None))
                        .when(to_num(v).isNotNull(), F.lit("number")).otherwise(F.lit("text")))
    return rows.withColumn("kinds", kinds)


def read_csv(spark: SparkSession, paths, spec: JobSpec, guess_header: bool = False,
             width: int | None = None) -> DataFrame:
    """CSV files read as the spec says (delimiter, encoding, skipped rows, header row),
    selected and renamed; all cells are text (type after rename)."""
    from ..operators.project import filter_and_rename
    rows = read_csv_rows(spark, paths, spec.delimiter, spec.encoding, width or spec.csv_width, spec.multiline)
    rows = drop_skipped(rows, spec.skiprows)          # row numbers below count without the skipped ones
    header_rows = header_row_guess_rows(rows) if guess_header else None
    frame, _ = apply_header(rows, spec, header_rows)
    data = [c for c in frame.columns if c not in LINEAGE]
    frame = frame.withColumns({c: F.when(~qc(c).isin(*NULL_MARKS), qc(c)) for c in data}) if data else frame
    return frame if spec.headers else filter_and_rename(frame, spec)


def preview(spark: SparkSession, paths, spec: JobSpec, n: int = 10) -> DataFrame:
    """First ``n`` data rows of every file."""
    from ..operators.order import head_per_file
    return head_per_file(read_csv(spark, paths, spec), n)
