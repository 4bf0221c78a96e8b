"""The template transform as one lazy Spark plan (order of the steps is part of the semantics).

unpivot -> provider stamp -> empty rows -> sparse columns -> trim -> thousands -> date parse and
drop -> amount parse -> group sum -> keep-first de-duplication.

All row-local steps are expressions in one projection chain, so they run inside one
whole-stage-codegen span next to the scan. Row drops are carried as flag columns until the end of
the row-local part: the per-file ledger then needs one aggregate over that frame, not one per
step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import parse_timestamp, strip_thousands, to_num, trim_ws
from ..operators.aggregate import group_sum
from ..operators.clean import strip_thousands_text, trim_text
from ..operators.filters import apply_sparse_decision, sparse_decision
from ..operators.layouts import parse_dates
from ..operators.lineage import LAYOUT, LINEAGE, file_keys, qc
from ..operators.order import dedupe_first
from ..operators.project import stamp_provider
from ..operators.reshape import unpivot
from ..spec import AMOUNT_FIELD, DATE_FIELD, PROVIDER_FIELD, JobSpec

EMPTY = "__empty"
DATE_BAD = "__date_bad"
DATE_MISSING = "__date_missing"
NUM_BAD = "__num_bad"
PARSED = "__parsed_date"
FLAGS = (EMPTY, DATE_BAD, DATE_MISSING, NUM_BAD)


@dataclass
class Transformed:
    frame: DataFrame                      # the clean rows
    flagged: DataFrame                    # row-level frame with drop flags (ledger input)
    pre_dedupe: DataFrame | None = None   # frame entering de-duplication, when it runs
    unpivot_info: dict | None = None
    notes: list = field(default_factory=list)


def _guessed(df: DataFrame, spec: JobSpec) -> bool:
    return spec.guess_dates and isinstance(df.schema[DATE_FIELD].dataType, StringType)


def transform(df: DataFrame, spec: JobSpec, per_file: bool = True) -> Transformed:
    notes: list[str] = []
    info = None
    carry = []
    if spec.unpivot:                                                     # R1
        ids = [c for c in spec.unpivot_ids() if c in df.columns]
        if DATE_FIELD in ids:   # cells that every molten row repeats are cleaned and parsed before the melt
            text = F.col(DATE_FIELD)
            if isinstance(df.schema[DATE_FIELD].dataType, StringType):
                text = trim_ws(text) if spec.trim_strings else text
                text = strip_thousands(text) if spec.strip_thousands else text
            df = parse_dates(df.withColumn(PARSED, text), [PARSED]) if _guessed(df, spec) else \
                df.withColumn(PARSED, parse_timestamp(text, spec.date_formats, df.schema[DATE_FIELD].dataType))
            carry = [PARSED]
        df, info = unpivot(df, spec.unpivot_ids(), spec.var_name, spec.value_name, carry)
        if info is None:
            notes.append("unpivot requested but no identifier columns found")
    df = stamp_provider(df, spec)                                        # P9
    source_cols = [c for c in df.columns if c not in LINEAGE and c not in (PROVIDER_FIELD, PARSED)]
    if spec.drop_empty_rows and source_cols:                             # F9 (source columns)
        empty = F.lit(True)
        for c in source_cols:
            empty = empty & qc(c).isNull()
        df = df.withColumn(EMPTY, empty)
    else:
        df = df.withColumn(EMPTY, F.lit(False))
    if spec.drop_null_columns_threshold is not None:                    # F10
        live = df.where(~F.col(EMPTY)).drop(EMPTY, PARSED)
        kept, mixed, flags = sparse_decision(live, spec.drop_null_columns_threshold, per_file)
        dropped = [c for c in live.columns if c not in kept and c not in LINEAGE]
        if dropped:
            notes.append(f"sparse columns dropped: {', '.join(dropped)}")
        df = apply_sparse_decision(df, kept, mixed, flags)
    if spec.trim_strings:                                                # C1
        df = trim_text(df)
    if spec.strip_thousands:                                             # C2
        df = strip_thousands_text(df)
    # in a stacked frame a rule on a field holds for the files that have it
    has = lambda c: F.array_contains(LAYOUT, c) if LAYOUT in df.columns else F.lit(True)
    if DATE_FIELD in df.columns:                                         # C3 + F11
        raw = F.col(DATE_FIELD)
        if not carry and _guessed(df, spec):
            df, carry = parse_dates(df.withColumn(PARSED, raw), [PARSED]), [PARSED]
        parsed = F.col(PARSED) if carry else parse_timestamp(raw, spec.date_formats, df.schema[DATE_FIELD].dataType)
        df = (df.withColumn("__date", parsed)
                .withColumn(DATE_BAD, raw.isNotNull() & F.col("__date").isNull())
                .withColumn(DATE_MISSING, F.col("__date").isNull() & has(DATE_FIELD))
                .withColumn(DATE_FIELD, F.col("__date")).drop("__date", PARSED))
    else:
        df = df.withColumn(DATE_BAD, F.lit(False)).withColumn(DATE_MISSING, F.lit(False))
    if AMOUNT_FIELD in df.columns:                                       # C4
        raw = F.col(AMOUNT_FIELD)
        num = to_num(raw, df.schema[AMOUNT_FIELD].dataType)
        df = (df.withColumn("__num", num)
                .withColumn(NUM_BAD, raw.isNotNull() & F.col("__num").isNull())
                .withColumn(AMOUNT_FIELD, F.coalesce(F.col("__num"), F.when(has(AMOUNT_FIELD), F.lit(0.0)))).drop("__num"))
    else:
        df = df.withColumn(NUM_BAD, F.lit(False))
    flagged = df
    if spec.combine_on:                                                  # F11 folded into A1
        kept = (~F.col(EMPTY) & ~F.col(DATE_MISSING)).alias("__ok")
        out = df.where(~F.col(EMPTY)).select("*", kept).drop(*FLAGS)
        out = group_sum(out, spec.combine_on, spec.var_name if spec.unpivot else None, per_file, row_ok="__ok",
                        constant=spec.provider_name)
        if "__ok" in out.columns:
            out = out.where(F.col("__ok")).drop("__ok")
    else:
        out = df.where(~F.col(EMPTY) & ~F.col(DATE_MISSING)).drop(*FLAGS)
    pre = None
    if spec.dedupe_on:                                                   # D1
        pre = out
        out = dedupe_first(out, spec.dedupe_on, per_file)
    return Transformed(out, flagged, pre, info, notes)


def row_counts() -> list:
    """Counts of the ledger over a flagged frame, as aggregates (K5)."""
    live, dated = ~F.col(EMPTY), ~F.col(DATE_MISSING)
    return [F.count(F.lit(1)).alias("rows_in"),
            F.sum(F.col(EMPTY).cast("long")).alias("empty_rows"),
            F.sum((live & F.col(DATE_BAD)).cast("long")).alias("date_parse_failures"),
            F.sum((live & dated & F.col(NUM_BAD)).cast("long")).alias("numeric_parse_failures"),
            F.sum((live & dated).cast("long")).alias("rows_kept")]


def ledger_counts(t: Transformed) -> DataFrame:
    """Per-file counts for the ledger from the flagged frame (one aggregate)."""
    return t.flagged.groupBy(*file_keys(t.flagged)).agg(*row_counts())
