"""A1-A10: group sums, totals and column profiles (single-pass aggregates)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions import to_num
from ..spec import PROVIDER_FIELD
from .heavy import COUNTERS, most_frequent
from .lineage import FILE, LINEAGE, NUMERIC, ORD, file_keys, qc

log = logging.getLogger(__name__)

# Profile thresholds of the header heuristics.
NUMERIC_SHARE = 0.6
YEAR_SHARE = 0.6
YEAR_LOW, YEAR_HIGH = 1900, 2100
TEXTY_MEAN_LEN = 12
TEXTY_MAX_NUMERIC = 0.3


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (NumericType, BooleanType))


def group_sum(df: DataFrame, keys, var_name: str | None = None, per_file: bool = True,
              row_ok: str | None = None, constant: str | None = None) -> DataFrame:
    """A1: sum every numeric column by the keys (+ unpivot variable, + provider).

    Rows with a null key are dropped; an all-null group sums to null; non-numeric, non-key columns
    leave the frame. Aggregation is partial per partition first, so a hot key costs one row per
    map task in the shuffle. With ``per_file`` the groups stay inside their source file. ``constant``: a provider that is the
    same for all rows; it is set afterwards and not grouped by, so a later step keyed as the groups needs no shuffle of its own.
    """
    present = [k for k in keys if k in df.columns]
    if not present:
        log.warning("combine_on keys not found in columns; skipping aggregation")
        return df.where(F.col(row_ok)).drop(row_ok) if row_ok else df
    group = list(present)
    if var_name and var_name in df.columns and var_name not in group:
        group.append(var_name)
    fixed = constant is not None and PROVIDER_FIELD in df.columns and PROVIDER_FIELD not in group
    if PROVIDER_FIELD in df.columns and PROVIDER_FIELD not in group and not fixed:
        group.append(PROVIDER_FIELD)
    scope = [c for c in file_keys(df) if c not in group] if per_file else []
    # text columns that are numbers in some files are summed there and null in the others
    mixed = set(df.schema[NUMERIC].metadata.get("columns", [])) if NUMERIC in df.columns else set()
    numeric = [c for c in df.columns if c not in group and c not in LINEAGE and c not in (row_ok, PROVIDER_FIELD if fixed else None)
               and (_is_numeric(df, c) or c in mixed)]
    if not numeric:
        log.warning("combine_on=%s requested but no numeric columns to aggregate", ",".join(present))
        return df.where(F.col(row_ok)).drop(row_ok) if row_ok else df

    def value(c):
        v = qc(c).cast("long") if isinstance(df.schema[c].dataType, BooleanType) else qc(c)
        if not _is_numeric(df, c):
            v = F.when(F.array_contains(NUMERIC, c), to_num(qc(c)))
        return F.when(F.col(row_ok), v) if row_ok else v

    sums = [F.sum(value(c)).alias(c) for c in numeric]
    not_null = F.lit(True)
    for g in group:
        not_null = not_null & qc(g).isNotNull()
    # ``row_ok``: rows that an earlier step drops take part in no sum, and a group made only of
    # such rows is not emitted (same result as dropping them first, but the test that decides it
    # runs inside the aggregation rather than being pushed into the scan)
    if row_ok:
        sums.append(F.max(F.col(row_ok).cast("int")).alias("__any_ok"))
    out = df.where(not_null).groupBy(*[qc(c) for c in scope + group]).agg(*sums)
    if row_ok:
        out = out.where(F.col("__any_ok") == 1).drop("__any_ok")
    out = out.withColumn(ORD, F.struct(*[qc(g) for g in group]))
    given = [F.lit(constant).alias(PROVIDER_FIELD)] if fixed else []
    return out.select(*[qc(c) for c in group], *given, *[qc(c) for c in numeric + scope], ORD)


def provider_totals(df: DataFrame, amount: str = "sales_amount", provider: str = PROVIDER_FIELD) -> DataFrame:
    """A2: total amount per provider."""
    return df.groupBy(provider).agg(F.sum(amount).alias(f"total_{amount}"))


def frame_profile(df: DataFrame) -> DataFrame:
    """A3: rows, columns and null cells in one aggregate."""
    cols = [c for c in df.columns if c not in LINEAGE]
    nulls = sum((qc(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("null_cells")) \
        .select("rows", F.lit(len(cols)).alias("columns"),
                F.coalesce("null_cells", F.lit(0).cast("long")).alias("null_cells"))


def value_counts_top(df: DataFrame, column: str, k: int = 25, counters: int = COUNTERS) -> DataFrame:
    """A4 / D3: most frequent values, nulls left out, ties broken by value.

    Candidates come from summaries of the tasks (``heavy``), and only their rows are counted, so a column with countless rare values does not
    cross the network. Where the summaries cannot tell which values lead, all values are counted.
    """
    found = most_frequent(df, qc(column), k, counters)
    rows = df.where(qc(column).isNotNull()).select(qc(column))
    if found is not None:
        rows = rows.join(found, qc(column).cast("string") == found["value"], "left_semi")
    return rows.groupBy(qc(column)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), qc(column).asc()).limit(k)


def column_profile(df: DataFrame, columns=None, per_file: bool = True) -> DataFrame:
    """One aggregate pass, then one row per (file, column).

    ``numeric_ratio`` counts nulls in the denominator; ``year_like`` is the share of parsed
    numbers in 1900..2100 (> 0.6, false without numbers); ``mean_len`` counts null as length 0.
    """
    cols = [c for c in (columns or df.columns) if c not in LINEAGE]
    scope = file_keys(df) if per_file else []
    # parse and measure each cell once in a projection; the aggregates then read plain columns
    cells = df.select(*[qc(c) for c in scope],
                      *[to_num(qc(c), df.schema[c].dataType).alias(f"__x{i}") for i, c in enumerate(cols)],
                      *[F.length(F.coalesce(qc(c).cast("string"), F.lit(""))).alias(f"__l{i}")
                        for i, c in enumerate(cols)])
    aggs = []
    for i, c in enumerate(cols):
        num = F.col(f"__x{i}")
        aggs += [
            F.avg(num.isNotNull().cast("double")).alias(f"r{i}"),
            F.count(num).alias(f"n{i}"),
            F.sum(num.between(YEAR_LOW, YEAR_HIGH).cast("long")).alias(f"y{i}"),
            F.avg(F.col(f"__l{i}")).alias(f"l{i}"),
        ]
    df = cells
    wide = df.groupBy(*scope).agg(*aggs)
    entries = ", ".join(f"{i}, '{c.replace(chr(39), chr(39) * 2)}', r{i}, n{i}, y{i}, l{i}"
                        for i, c in enumerate(cols))
    long = wide.selectExpr(*scope, f"stack({len(cols)}, {entries}) as "
                           "(ordinal, column, numeric_ratio, numbers, years, mean_len)")
    year_like = F.coalesce(F.col("numbers") > 0, F.lit(False)) & \
        ((F.col("years") / F.col("numbers")) > YEAR_SHARE)
    return (long
            .withColumn("year_like", F.coalesce(year_like, F.lit(False)))
            .withColumn("is_numeric", (F.col("numeric_ratio") > NUMERIC_SHARE) & ~F.col("year_like"))
            .withColumn("is_texty", (F.col("mean_len") > TEXTY_MEAN_LEN) &
                        (F.col("numeric_ratio") < TEXTY_MAX_NUMERIC))
            .select(*scope, F.col("ordinal").cast("int").alias("ordinal"), "column", "numeric_ratio",
                    "year_like", "mean_len", "is_numeric", "is_texty"))


def file_sizes(df: DataFrame) -> DataFrame:
    """Rows per file (and sheet, when the frame has one) and the number of data columns
    (the file's own columns when the frame stacks several layouts)."""
    from .lineage import LAYOUT, SHEET
    cols = [c for c in df.columns if c not in LINEAGE and c != SHEET]
    scope = file_keys(df) + ([SHEET] if SHEET in df.columns else [])
    width = F.max(F.size(LAYOUT)) if LAYOUT in df.columns else F.lit(len(cols))
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows"), width.alias("columns"))


def type_labels(df: DataFrame) -> list[tuple[str, str]]:
    """C14: display type of each data column from the schema (Date, Boolean, Number, Text).

    Boolean is tested before Number, so boolean columns are labelled as such.
    """
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
    out = []
    for f in df.schema.fields:
        if f.name in LINEAGE:
            continue
        t = f.dataType
        if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
            label = "Date"
        elif isinstance(t, BooleanType):
            label = "Boolean"
        elif isinstance(t, NumericType):
            label = "Number"
        else:
            label = "Text"
        out.append((f.name, label))
    return out
