"""Lineage columns every operator understands.

``source_file`` names the input file for display, ``__path`` tells files apart (the per-file scope of the
template semantics; frames built by hand may do with the name alone), and ``__ord`` is a sortable struct that reproduces the row order of the inputs. Row order matters for
keep-first de-duplication and for header rows, and Spark does not keep it by itself once a frame
is shuffled, so it is carried as data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = "source_file"
# the full path of the input: what files are told apart by (names repeat across folders)
KEY = "__path"
ORD = "__ord"
SHEET = "source_sheet"
# names of the columns a row's own file has (set by scans that stack several header layouts)
LAYOUT = "__cols"
# names of the text columns that are numbers in a row's own file, where files differ
NUMERIC = "__numeric"
LINEAGE = (FILE, ORD, LAYOUT, KEY, NUMERIC)


def data_columns(df: DataFrame, exclude=()) -> list[str]:
    """Columns that carry data (no lineage, no explicit exclusions)."""
    skip = set(LINEAGE) | set(exclude)
    return [c for c in df.columns if c not in skip]


def file_keys(df: DataFrame) -> list[str]:
    """The columns that name a row's file: the path where the frame has it, and the display name."""
    return [c for c in (KEY, FILE) if c in df.columns]


def input_path():
    """Path of the input a Parquet row belongs to: a folder ``x.parquet`` that a job wrote counts as one input."""
    path = F.col("_metadata.file_path")
    return F.when(F.contains(path, F.lit(".parquet/")), F.concat(F.substring_index(path, ".parquet/", 1), F.lit(".parquet"))).otherwise(path)


def with_file_order(df: DataFrame, file_name: bool = True) -> DataFrame:
    """Add ``source_file``, ``__path`` and ``__ord`` to a file-based scan (Parquet: row index in the file).

    Must be applied directly on the scan, where ``_metadata`` is available.
    """
    out = df
    if file_name:
        out = out.withColumns({FILE: F.substring_index(input_path(), "/", -1), KEY: input_path()})
    return out.withColumn(
        ORD, F.struct(F.col("_metadata.file_path").alias("f"),
                      F.col("_metadata.row_index").alias("i")))


def with_generated_order(df: DataFrame) -> DataFrame:
    """Order column for sources without a file position (JDBC, in-memory): read order."""
    return df.withColumn(ORD, F.struct(F.monotonically_increasing_id().alias("i")))


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def qc(name: str):
    """Column by its exact name (dots, spaces and back-quotes in file headers are literal)."""
    return F.col("`" + name.replace("`", "``") + "`")


def where_files(df: DataFrame, files: DataFrame, keep: bool) -> DataFrame:
    """Rows whose file is (``keep``) or is not in ``files``: a semi / anti join on the file's columns, broadcast when the
    planner finds the list small."""
    on = [c for c in file_keys(df) if c in files.columns]
    return df.join(files.select(*on).distinct(), on, "left_semi" if keep else "left_anti")
