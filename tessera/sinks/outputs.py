"""K1-K4, K7, K8: clean output, combined output, quarantine, run status and retry lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import FILE, KEY, LAYOUT, NUMERIC, ORD, file_keys
from ..sources.files import plain_path


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite",
                only_own_parts: bool = False) -> str:
    """K1 / K2 / K3: Parquet (default) or CSV with a header row; the lineage columns but the file name are dropped.

    ``only_own_parts``: of a partitioned folder only the parts that ``df`` has rows for are replaced.
    """
    out = df.drop(*[c for c in (ORD, LAYOUT, KEY, NUMERIC) if c in df.columns])
    w = out.write.mode(mode)
    if only_own_parts:
        w = w.option("partitionOverwriteMode", "dynamic")
    parts = [c for c in (partition_by or []) if c in out.columns]
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported output format {fmt} (xlsx outputs are written as csv or parquet)")
    return path


def with_file_id(df: DataFrame) -> DataFrame:
    """Adds ``file_id``, which tells apart inputs of one name from different folders in the outputs."""
    return df.withColumn("file_id", F.hex(F.xxhash64(plain_path(KEY)))) if KEY in df.columns else df


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", per_file: bool = True) -> str:
    """K1: clean rows, one output folder per company, source file and file id. A run replaces the folders of its own files
    and leaves those of earlier runs. Rows are dealt by folder first, so that a folder gets few files; Spark splits large ones."""
    if not per_file:
        return write_frame(df, path, fmt)
    out = with_file_id(df)
    parts = [c for c in ("company", FILE, "file_id") if c in out.columns]
    return write_frame(out.hint("rebalance", *parts), path, fmt, parts, only_own_parts=True)


def quarantine_rows(raw: DataFrame, failed: DataFrame) -> DataFrame:
    """K4: input rows of files that failed, with the reason; a file without rows, such as one that cannot be read, has one row
    with nothing but its name and the reason."""
    keys = [c for c in file_keys(raw) if c in failed.columns]
    rows = raw.join(failed.select(*keys, "reason"), keys)
    bare = failed.join(raw.select(*keys).distinct(), keys, "left_anti").select(*keys, "reason")
    return rows.unionByName(bare, allowMissingColumns=True)


def latest(ledger: DataFrame) -> DataFrame:
    """The last ledger row of every input (by path; by name where a ledger has no paths)."""
    by = F.coalesce("path", FILE) if "path" in ledger.columns else F.col(FILE)
    last = F.max_by(F.struct(*ledger.columns), "run_ts").alias("r")
    return ledger.groupBy(by.alias("__by")).agg(last).select("r.*")


def run_status(ledger: DataFrame) -> DataFrame:
    """K7: per status, the number of files (as of their last run) and the latest run time."""
    return latest(ledger).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.max("run_ts").alias("last_run"))


def retry_paths(ledger: DataFrame) -> DataFrame:
    """K8: paths of quarantined inputs, to run again."""
    return ledger.where(F.col("status") == "quarantined").select("path").distinct()
