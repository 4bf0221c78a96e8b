"""R1 companions C1-C8 and V6: text cleaning, parsing and declared types with failure counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import parse_timestamp, strip_thousands, to_num, to_whole, trim_ws
from ..spec import DEFAULT_DATE_FORMATS
from .lineage import LINEAGE, qc

# Declared type names and the family they belong to.
DATE_TYPES = {"date", "datetime"}
INT_TYPES = {"int", "integer"}
FLOAT_TYPES = {"float", "number", "numeric"}
TEXT_TYPES = {"str", "string", "text"}


def text_columns(df: DataFrame, columns=None) -> list[str]:
    names = columns if columns is not None else df.columns
    return [c for c in names if c in df.columns and c not in LINEAGE
            and isinstance(df.schema[c].dataType, StringType)]


def trim_text(df: DataFrame, columns=None) -> DataFrame:
    """Trim every text column; null stays null."""
    cols = text_columns(df, columns)
    return df.withColumns({c: trim_ws(c) for c in cols}) if cols else df


def strip_thousands_text(df: DataFrame, columns=None) -> DataFrame:
    """Remove commas and whitespace from every text column."""
    cols = text_columns(df, columns)
    return df.withColumns({c: strip_thousands(c) for c in cols}) if cols else df


def failure_flag(before: Column, after: Column) -> Column:
    """1 where a non-null input became null: the unit every failure count sums."""
    return (before.isNotNull() & after.isNull()).cast("int")


def typed_value(df: DataFrame, column: str, type_name: str,
                formats=DEFAULT_DATE_FORMATS) -> Column | None:
    """Typed expression for a declared type name (C5-C8); unknown names give ``None``."""
    t = str(type_name).lower()
    dtype = df.schema[column].dataType
    if t in DATE_TYPES:
        return parse_timestamp(column, formats, dtype)          # C5
    if t in INT_TYPES:
        return to_whole(column, dtype)                          # C6
    if t in FLOAT_TYPES:
        return to_num(column, dtype)                            # C7
    if t in TEXT_TYPES:
        return qc(column).cast("string")                     # C8
    return None


def coerce_types(df: DataFrame, type_map: dict, formats=DEFAULT_DATE_FORMATS,
                 flag_prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """V6: apply declared types; absent columns and unknown types are skipped.

    With ``flag_prefix`` a 0/1 failure column per typed column is kept next to the value, so the
    failure counts come out of the same pass that writes the data. Returns the frame and the
    names of the typed columns.
    """
    typed = {}
    flags = {}
    for column, type_name in type_map.items():
        if column not in df.columns:
            continue
        expr = typed_value(df, column, type_name, formats)
        if expr is None:
            continue
        typed[column] = expr
        if flag_prefix is not None:
            flags[f"{flag_prefix}{column}"] = failure_flag(qc(column), expr)
    if flags:
        df = df.withColumns(flags)
    return (df.withColumns(typed) if typed else df), list(typed)


def failure_counts(df: DataFrame, type_map: dict, formats=DEFAULT_DATE_FORMATS,
                   group: list[str] | None = None) -> DataFrame:
    """V6 report: one row per (group, column) with the number of failed cells (>0 only)."""
    exprs = []
    for column, type_name in type_map.items():
        if column not in df.columns:
            continue
        expr = typed_value(df, column, type_name, formats)
        if expr is None:
            continue
        exprs.append((column, str(type_name).lower(),
                      F.sum(failure_flag(qc(column), expr)).alias(column)))
    group = group or []
    if not exprs:
        return df.sparkSession.createDataFrame([], "column string, type string, failures long")
    agg = df.groupBy(*group).agg(*[e for _, _, e in exprs])
    stack = ", ".join(f"'{c}', '{t}', `{c}`" for c, t, _ in exprs)
    long = agg.selectExpr(*[f"`{g}`" for g in group],
                          f"stack({len(exprs)}, {stack}) as (column, type, failures)")
    return long.where(F.col("failures") > 0).withColumn("failures", F.col("failures").cast("long"))
