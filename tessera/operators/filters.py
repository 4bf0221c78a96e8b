"""Row filters and the filter query."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import checkpointed
from .lineage import LINEAGE, file_keys, qc

# One entry per operator: what a cell and a value make of a row. A null cell matches "!=" alone.
CONDITIONS = {
    "=": lambda c, v: c == F.lit(v),                                              # F1
    "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)),                                   # F2
    ">": lambda c, v: c > F.lit(v),                                               # F3
    ">=": lambda c, v: c >= F.lit(v),                                             # F4
    "<": lambda c, v: c < F.lit(v),                                               # F5
    "<=": lambda c, v: c <= F.lit(v),                                             # F6
    "contains": lambda c, v: F.coalesce(c.cast("string").rlike(str(v)), F.lit(False)),  # a pattern
}
OPERATORS = tuple(CONDITIONS)


@dataclass(frozen=True)
class Term:
    """One filter: column, operator (default "=") and value, blanks around them ignored."""

    column: str
    op: str = "="
    value: str = ""

    @classmethod
    def of(cls, given) -> "Term":
        """From a term, a (column, operator, value) triple or a dict with ``column``, ``operator``, ``value``."""
        if isinstance(given, cls):
            return given
        parts = [given.get(k) for k in ("column", "operator", "value")] if isinstance(given, dict) else list(given)
        column, op, value = ("" if p is None else str(p).strip() for p in parts)
        return cls(column, op or "=", value)


def _terms(filters) -> list[Term]:
    return [Term.of(f) for f in filters or []]


def typed_literal(dtype, text: str):
    """The value as the column's kind of literal; None if a number is asked for and it is none."""
    if not isinstance(dtype, NumericType):
        return text
    try:
        return float(text)
    except ValueError:
        return None


def term_condition(df: DataFrame, term: Term):
    """Condition of one filter term, or ``None`` when the term is skipped.

    Skipped: empty or unknown column or operator, empty value, numeric column with a non-number value.
    """
    make = CONDITIONS.get(term.op.lower())
    if make is None or term.column not in df.columns or term.value == "":
        return None
    value = typed_literal(df.schema[term.column].dataType, term.value)
    if value is None:
        return None
    return make(qc(term.column), term.value if term.op.lower() == "contains" else value)


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """AND of all applicable terms, pushed down by Catalyst where the source allows."""
    conds = [c for c in (term_condition(df, t) for t in _terms(filters)) if c is not None]
    for cond in conds:
        df = df.where(cond)
    return df


def _quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def build_sql(view: str, columns, filters, df_columns=None) -> tuple[str, dict]:
    """F8: the filter query as SQL text with bound parameters (``LIKE '%v%'`` for contains)."""
    cols = ", ".join(_quote_ident(c) for c in columns) if columns else "*"
    parts, args = [], {}
    for i, t in enumerate(_terms(filters)):
        if not t.column or not t.value or (df_columns is not None and t.column not in df_columns):
            continue
        name = f"p{i}"
        if t.op.lower() == "contains":
            parts.append(f"{_quote_ident(t.column)} LIKE :{name}")
            args[name] = f"%{t.value}%"
        elif t.op in OPERATORS:
            parts.append(f"{_quote_ident(t.column)} {t.op} :{name}")
            args[name] = t.value
    where = f" WHERE {' AND '.join(parts)}" if parts else ""
    return f"SELECT {cols} FROM {_quote_ident(view)}{where}", args


def filter_sql(spark: SparkSession, df: DataFrame, columns, filters, view: str | None = None) -> DataFrame:
    """F8: run the filter query as parameterised SQL over a temp view of ``df`` (a name of its own by default)."""
    view = view or f"filter_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    text, args = build_sql(view, columns, filters, df.columns)
    return spark.sql(text, args=args)


def drop_empty_rows(df: DataFrame, exclude=()) -> DataFrame:
    """drop rows whose data cells are all null (lineage and ``exclude`` not counted)."""
    cols = [c for c in df.columns if c not in LINEAGE and c not in set(exclude)]
    if not cols:
        return df
    empty = F.lit(True)
    for c in cols:
        empty = empty & qc(c).isNull()
    return df.where(~empty)


def sparse_decision(df: DataFrame, threshold: float, per_file: bool = True):
    """F10 decision: ``(kept, mixed, flags)``.

    Shares are taken per file in one aggregate pass (one row per file). A file where no column
    qualifies keeps all of its columns. A column leaves the schema only when no file keeps it
    (``kept`` lists the survivors); ``mixed`` are kept columns some files drop, and ``flags`` is
    the small per-file table that says which (``None`` when there are none). Only the one-row
    summary of the decision reaches the driver.
    """
    cols = [c for c in df.columns if c not in LINEAGE]
    if not cols:
        return cols, [], None
    scoped = file_keys(df) if per_file else []
    share = [F.avg(qc(c).isNotNull().cast("double")).alias(f"__s{i}") for i, c in enumerate(cols)]
    stats = df.groupBy(*scoped).agg(*share)
    keep = [F.coalesce(F.col(f"__s{i}") >= threshold, F.lit(False)) for i in range(len(cols))]
    any_keep = keep[0]
    for k in keep[1:]:
        any_keep = any_keep | k
    decision = stats.select(*scoped, *[F.when(any_keep, k).otherwise(F.lit(True)).alias(c) for k, c in zip(keep, cols)])
    decision = checkpointed(decision) if scoped else decision  # one row per file, used by all that follows
    summary = decision.agg(*[F.max(qc(c).cast("int")).alias(f"any_{i}") for i, c in enumerate(cols)],
                           *[F.min(qc(c).cast("int")).alias(f"all_{i}") for i, c in enumerate(cols)]
                           ).first()
    if summary is None or summary[0] is None:   # empty frame: unchanged
        return cols, [], None
    kept = [c for i, c in enumerate(cols) if summary[f"any_{i}"] == 1]
    mixed = [c for i, c in enumerate(cols) if c in kept and summary[f"all_{i}"] == 0]
    flags = None
    if mixed and scoped:
        flags = decision.select(*scoped, *[qc(c).alias(f"__keep_{c}") for c in mixed])
    return kept, mixed, flags


def apply_sparse_decision(df: DataFrame, kept, mixed, flags) -> DataFrame:
    """F10 application: null the cells of files that drop a column, then drop dead columns."""
    out = df
    if mixed and flags is not None:
        out = out.join(flags, file_keys(df), "left")
        out = out.select(*[F.when(qc(f"__keep_{c}"), qc(c)).alias(c) if c in mixed else qc(c) for c in df.columns])
    keep = set(kept)
    return out.select(*[qc(c) for c in df.columns if c in keep or c in LINEAGE or c.startswith("__")])


def drop_sparse_columns(df: DataFrame, threshold: float, per_file: bool = True) -> DataFrame:
    """drop columns whose non-null share is below ``threshold`` (see ``sparse_decision``)."""
    kept, mixed, flags = sparse_decision(df, threshold, per_file)
    return apply_sparse_decision(df, kept, mixed, flags)


def drop_null_dates(df: DataFrame, column: str) -> DataFrame:
    """drop rows without a parsed date."""
    return df.where(qc(column).isNotNull()) if column in df.columns else df
