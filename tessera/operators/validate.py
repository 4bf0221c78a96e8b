"""V1-V8: schema drift, contract validation, error tables and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import parse_timestamp, to_num
from ..spec import JobSpec
from .clean import DATE_TYPES, FLOAT_TYPES, INT_TYPES, TEXT_TYPES, typed_value
from .lineage import FILE, LAYOUT, LINEAGE, ORD, SHEET, file_keys, qc

# The output contract. All optional, nullable, coerced; extra columns allowed.
CONTRACT = (
    ("provider_id", "string"),
    ("article_sku", "string"),
    ("report_date", "timestamp"),
    ("sales_amount", "double"),
)
# Lineage the job adds itself: listed in drift but never failing the gate.
OWN_COLUMNS = ("provider_id", SHEET, FILE)

ERROR_SCHEMA = StructType([
    StructField(FILE, StringType()),
    StructField("column", StringType()),
    StructField("check", StringType()),
    StructField("failure_case", StringType()),
    StructField("row", StringType()),
])


def schema_diff(columns, expected) -> tuple[list[str], list[str]]:
    """V1 on name lists: (missing, extra), both sorted."""
    cur, exp = set(columns), set(expected or [])
    return sorted(exp - cur), sorted(cur - exp)


def drift(df: DataFrame, spec: JobSpec) -> tuple[list[str], list[str]]:
    """V1 against the spec's expected names (none expected: no check)."""
    expected = spec.expected_headers()
    if not expected:
        return [], []
    return schema_diff([c for c in df.columns if c not in LINEAGE], expected)


def columns_by_file(df: DataFrame) -> DataFrame:
    """(file columns, present): the data columns each file of a frame has. Scans that stack several layouts know them by name;
    in other stacked frames a column counts as a file's when it has a value there. One aggregate pass."""
    keys = file_keys(df)
    if LAYOUT in df.columns:
        return df.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set(LAYOUT))).alias("present"))
    cols = [c for c in df.columns if c not in LINEAGE]
    counts = df.groupBy(*keys).agg(*[F.count(qc(c)).alias(f"__n{i}") for i, c in enumerate(cols)])
    present = F.filter(F.array(*[F.when(F.col(f"__n{i}") > 0, F.lit(c)) for i, c in enumerate(cols)]), lambda x: x.isNotNull())
    return counts.select(*keys, present.alias("present"))


def drift_by_file(df: DataFrame, expected: list[str]) -> DataFrame:
    """V1 per file of a stacked frame: set differences on arrays whose size is bounded by the width of the frame."""
    exp = F.array(*[F.lit(c) for c in expected]) if expected else F.array().cast("array<string>")
    return columns_by_file(df).select(
        *file_keys(df),
        F.array_sort(F.array_except(exp, "present")).alias("missing"),
        F.array_sort(F.array_except("present", exp)).alias("extra"))


def drift_gate(drift_df: DataFrame, fail_on_missing: bool, fail_on_extra: bool) -> DataFrame:
    """V2: verdict column; columns the job adds itself never fail the gate."""
    own = F.array(*[F.lit(c) for c in OWN_COLUMNS])
    extra = F.array_except(F.col("extra"), own)
    fail = F.lit(False)
    if fail_on_missing:
        fail = fail | (F.size("missing") > 0)
    if fail_on_extra:
        fail = fail | (F.size(extra) > 0)
    return drift_df.withColumn("drift_failed", fail)


def _contract_exprs(df: DataFrame, spec: JobSpec):
    out = {}
    for name, kind in CONTRACT:
        if name not in df.columns:
            continue
        dtype = df.schema[name].dataType
        if kind == "timestamp":
            out[name] = parse_timestamp(name, spec.date_formats, dtype)
        elif kind == "double":
            out[name] = to_num(name, dtype)
        else:
            out[name] = qc(name).cast("string")
    return out


def _failed_cells(typed: dict, check: dict):
    """Array of the cells that were set and did not survive coercion."""
    cells = [F.when(qc(c).isNotNull() & expr.isNull(), F.struct(F.lit(c).alias("column"), F.lit(check[c]).alias("check"),
                                                                qc(c).cast("string").alias("failure_case")))
             for c, expr in typed.items()]
    return F.filter(F.array(*cells), lambda e: e.isNotNull()) if cells else F.array().cast(
        "array<struct<column:string,check:string,failure_case:string>>")


def _declared(df: DataFrame, spec: JobSpec) -> dict:
    typed = {c: typed_value(df, c, t, spec.date_formats) for c, t in spec.field_types.items() if c in df.columns}
    return {c: e for c, e in typed.items() if e is not None}


def validate(df: DataFrame, spec: JobSpec, level: str = "coerce") -> tuple[DataFrame, DataFrame]:
    """V3-V5: return the coerced frame and the error table (one row per failing cell).

    ``off``: frame unchanged, no errors. ``coerce``: the contract columns present are coerced.
    ``contract``: required columns must exist (else one error per missing column), declared
    types are applied with their failures, then the contract coercion. Both kinds of failures are gathered in one array per
    row, so the error table is one scan.
    """
    level = (level or "coerce").lower()
    spark = df.sparkSession
    empty = spark.createDataFrame([], ERROR_SCHEMA)
    if level == "off":
        return df, empty
    typed = {}
    if level == "contract":
        missing = [f for f in spec.required_fields if f not in df.columns]
        if missing:
            rows = [(None, m, "column_in_dataframe", "missing required column", None) for m in missing]
            return df, spark.createDataFrame(rows, ERROR_SCHEMA)
        typed = _declared(df, spec)
    check = {c: f"coerce to {str(t).lower()}" for c, t in spec.field_types.items()}
    both = df.withColumn("__declared", _failed_cells(typed, check)).withColumns(typed)
    contract = _contract_exprs(both, spec)
    both = both.withColumn("__bad", F.concat("__declared", _failed_cells(contract, {c: f"coerce to {k}" for c, k in CONTRACT})))
    file_col = F.col(FILE) if FILE in df.columns else F.lit(None).cast("string")
    row_col = F.to_json(F.col(ORD)) if ORD in df.columns else F.lit(None).cast("string")
    # explode_outer + filter: an inner explode makes the optimizer infer ``size(…) > 0``, push the
    # whole coercion below it and evaluate it twice
    bad = both.select(file_col.alias(FILE), row_col.alias("row"), F.explode_outer("__bad").alias("e")).where(F.col("e").isNotNull())
    out = df.withColumns(typed) if typed else df
    contract = _contract_exprs(out, spec)
    return (out.withColumns(contract) if contract else out), bad.select(FILE, "e.column", "e.check", "e.failure_case", "row")


FAILS = "__fails"


def with_row_failures(df: DataFrame, spec: JobSpec, level: str = "coerce") -> tuple[DataFrame, list[str]]:
    """The coerced frame plus ``__fails``, the number of failing cells of each row.

    Same checks as ``validate`` without building the error table, so the verdict and the ledger
    come out of one aggregate over the rows. Returns the frame and the required columns that no row has
    (contract level). Where files have columns of their own, ``missing_required`` tells the rest.
    """
    level = (level or "coerce").lower()
    if level == "off":
        return df.withColumn(FAILS, F.lit(0)), []
    fails = F.lit(0)
    if level == "contract":
        missing = [f for f in spec.required_fields if f not in df.columns]
        if missing and LAYOUT not in df.columns:
            return df.withColumn(FAILS, F.lit(0)), missing
        typed = _declared(df, spec)
        for c, e in typed.items():
            fails = fails + (qc(c).isNotNull() & e.isNull()).cast("int")
        df = df.withColumn(FAILS, fails).withColumns(typed) if typed else df
        fails = F.col(FAILS) if typed else fails
    contract = _contract_exprs(df, spec)
    for c, e in contract.items():
        fails = fails + (qc(c).isNotNull() & e.isNull()).cast("int")
    df = df.withColumn(FAILS, fails)
    return (df.withColumns(contract) if contract else df), []


def missing_required(present, spec: JobSpec, level: str):
    """Number of required columns that are not in the array ``present`` of a file's columns; such a file gets no other checks."""
    if (level or "coerce").lower() != "contract" or not spec.required_fields:
        return F.lit(0)
    return F.size(F.array_except(F.array(*[F.lit(c) for c in spec.required_fields]), present))


def verdict_one_pass(df: DataFrame, spec: JobSpec, level: str = "coerce") -> DataFrame:
    """V7 in one aggregate: per file the row count and the failing cells, then the flag."""
    typed, missing = with_row_failures(df, spec, level)
    keys = file_keys(df)
    own = [F.array_distinct(F.flatten(F.collect_set(LAYOUT))).alias("__names")] if LAYOUT in typed.columns else []
    out = typed.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *own,
                                   F.coalesce(F.sum(FAILS), F.lit(0)).cast("long").alias("errors"))
    lacking = missing_required(F.col("__names"), spec, level) if own else F.lit(len(missing))
    out = out.withColumn("errors", F.when(lacking > 0, lacking).otherwise(F.col("errors")).cast("long"))
    return out.withColumn("is_valid", F.col("errors") == 0).select(FILE, "is_valid", "errors", "row_count")


def verdict(df: DataFrame, errors: DataFrame) -> DataFrame:
    """V7: per file, valid flag, error count and row count (two small aggregates joined). Errors without a file are the schema's and
    count for every file."""
    if FILE not in df.columns:
        rows = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(FILE, F.lit(None).cast("string"))
    else:
        rows = df.groupBy(FILE).agg(F.count(F.lit(1)).alias("row_count"))
    errs = errors.where(F.col(FILE).isNotNull()).groupBy(F.col(FILE).alias("__f")).agg(F.count(F.lit(1)).alias("own"))
    common = errors.where(F.col(FILE).isNull()).agg(F.count(F.lit(1)).alias("common"))  # one row
    out = rows.join(errs, F.col(FILE) == F.col("__f"), "left").join(F.broadcast(common), F.lit(True))
    out = out.withColumn("errors", F.coalesce("own", F.lit(0)) + F.col("common"))
    return out.withColumn("is_valid", F.col("errors") == 0).select(FILE, "is_valid", "errors", "row_count")


def mapping_coverage(targets: DataFrame, mapping: DataFrame,
                     target_col: str = "target", mapped_col: str = "target") -> DataFrame:
    """V8: target fields that no column maps to."""
    t = targets.select(F.col(target_col).alias("target")).distinct()
    m = mapping.select(F.col(mapped_col).alias("target")).distinct()
    return t.join(m, "target", "left_anti")


__all__ = [
    "CONTRACT", "ERROR_SCHEMA", "DATE_TYPES", "FLOAT_TYPES", "INT_TYPES", "TEXT_TYPES",
    "drift", "drift_by_file", "drift_gate", "mapping_coverage", "schema_diff", "validate", "verdict",
]
