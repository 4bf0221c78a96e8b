"""Order-aware operators over the ``__ord`` lineage column."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import FILE, LINEAGE, ORD, file_keys, qc

log = logging.getLogger(__name__)


def dedupe_first(df: DataFrame, keys, per_file: bool = True) -> DataFrame:
    """Keep the first row (by ``__ord``) of every key; null keys are equal to each other.

    Written as ``min_by`` aggregation rather than a window: a key that holds a third of all rows sends one row per
    map task, not all of its rows to one sorter. Rows hold text, so Spark sorts each task's rows by key for it.
    """
    present = [k for k in keys if k in df.columns]
    if not present:
        log.warning("dedupe_on keys not found in columns; skipping dedupe")
        return df
    if ORD not in df.columns:
        raise ValueError("dedupe_first needs the __ord column for keep-first semantics")
    scope = [c for c in file_keys(df) if c not in present] if per_file else []
    rest = [c for c in df.columns if c not in present and c not in scope]
    first = F.min_by(F.struct(*[qc(c) for c in rest]), F.col(ORD)).alias("__first")
    out = df.groupBy(*[qc(c) for c in scope + present]).agg(first)
    return out.select(*[qc(c) if c in present or c in scope else F.col("__first")[c].alias(c)
                        for c in df.columns])


def head_per_file(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of every file (a ``row_number <= n`` window; Spark limits it per
    partition before the shuffle)."""
    w = Window.partitionBy(*file_keys(df)).orderBy(ORD)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """Row limit of a preview."""
    return df.limit(n)


def numeric_blocks(profile: DataFrame) -> DataFrame:
    """Maximal runs of adjacent numeric columns (gaps and islands over the ordinal).

    Input is the column profile (one row per file and column, so a window per file sorts at
    most a sheet's width). Output: ``columns`` in order, ``start_idx``, ``end_idx``, ``size``.
    """
    scope = file_keys(profile)
    nums = profile.where("is_numeric")
    w = Window.partitionBy(*scope).orderBy("ordinal") if scope else Window.orderBy("ordinal")
    islands = nums.withColumn("island", F.col("ordinal") - F.row_number().over(w))
    blocks = islands.groupBy(*scope, "island").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("members"),
        F.min("ordinal").alias("start_idx"), F.max("ordinal").alias("end_idx"))
    return blocks.select(*scope, F.transform("members", lambda m: m["column"]).alias("columns"),
                         "start_idx", "end_idx",
                         (F.col("end_idx") - F.col("start_idx") + 1).alias("size"))


def sort_by_order(df: DataFrame) -> DataFrame:
    """Rows in input order (for writing previews); a range shuffle, used only on small outputs."""
    return df.orderBy(ORD) if ORD in df.columns else df


def strip_lineage(df: DataFrame, keep_file: bool = True) -> DataFrame:
    drop = [c for c in LINEAGE if c in df.columns and not (keep_file and c == FILE)]
    return df.drop(*drop)
