"""The batch job: scan all files of one spec, transform, validate, write, and keep a ledger.

Files are told apart by their paths. Passes over the input: one aggregate that yields every per-file figure of the
ledger (row counts, drop flags, parse failures, presence of columns, cell errors), one write of the clean
rows, and one filtered read for the quarantine of failing files. Extra aggregates only when the
spec asks for sparse-column drops (F10) or group/dedupe (their counts come from the reduced frame). The ledger has a row for
every listed input, also for those without rows and those that cannot be read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import FILE, KEY, LAYOUT, LINEAGE, NUMERIC, ORD, SHEET, file_keys, qc, where_files
from ..operators.validate import FAILS, OWN_COLUMNS, missing_required, with_row_failures
from ..session import checkpointed
from ..sinks.outputs import latest, quarantine_rows, retry_paths, with_file_id, write_clean, write_frame
from ..sources.files import company_of, list_files, list_inputs, pair_specs, plain_path
from ..spec import AMOUNT_FIELD, JobSpec
from .transform import DATE_BAD, DATE_MISSING, EMPTY, NUM_BAD, row_counts, transform


@dataclass
class JobResult:
    ledger: DataFrame
    clean_path: str
    quarantine_path: str
    ledger_path: str
    totals: dict | None = None      # K6 job totals: rows and amount of the clean rows of this run


def scan(spark: SparkSession, spec: JobSpec, paths, kind: str | None = None, guess_header: bool = False,
         connections: dict | None = None, infer_numbers: bool = True) -> DataFrame:
    """Read every input of one spec as a single frame, by kind (csv, excel, parquet, sql).

    Text scans (csv, excel) give text cells; with ``infer_numbers`` a column whose every value is a
    number becomes a number column (whole numbers: long), as a typed reader would have it, so that
    group sums see it. That costs one aggregate pass; declared ``field_types`` need none.
    """
    return scan_with_errors(spark, spec, paths, kind, guess_header, connections, infer_numbers)[0]


def scan_with_errors(spark, spec, paths, kind=None, guess_header=False, connections=None, infer_numbers=True):
    """``scan`` and, for workbooks, the files that cannot be read: (path, source_file, message), else None."""
    if infer_numbers and (kind or spec.source_type or "excel").lower() == "csv" and not guess_header:
        from ..sources.csv_summary import read_csv_typed
        return read_csv_typed(spark, paths, spec, exclude=set(spec.field_types)), None
    frame, errors = _scan(spark, spec, paths, kind, guess_header, connections)
    if infer_numbers and (kind or spec.source_type or "excel").lower() not in ("sql", "parquet"):
        from ..sources.rows import infer_types
        frame = infer_types(frame, exclude=set(spec.field_types))
    return frame, errors


def _scan(spark, spec, paths, kind, guess_header, connections):
    kind = (kind or spec.source_type or "excel").lower()
    paths = [paths] if isinstance(paths, str) else list(paths or [])
    if kind == "sql":
        from ..operators.project import filter_and_rename
        from ..sources.jdbc import read_sql_with_spec
        return filter_and_rename(read_sql_with_spec(spark, spec, connections or {}), spec), None
    if kind == "parquet":
        from ..operators.project import filter_and_rename
        from ..sources.files import read_parquet
        return filter_and_rename(read_parquet(spark, paths), spec), None
    from ..sources.csv import read_csv
    if kind == "csv":
        return read_csv(spark, paths, spec, guess_header), None
    from ..sources.workbook import decode, decode_errors, read_workbooks
    decoded = decode(spark, paths)
    frame = read_workbooks(spark, paths, spec, guess_header, decoded)
    bad = decode_errors(decoded)
    # Files that are not workbooks are read as delimited text with the same spec (readers take paths as a list)
    fallback = [r["path"] for r in bad.where("rtype = 'not_zip'").select("path").toLocalIterator()]
    if fallback:
        from ..operators.combine import stack_by_name
        frame = stack_by_name([frame, read_csv(spark, fallback, spec, guess_header)])
    return frame, bad.where("rtype = 'error'").select("path", FILE, "message")


def kind_is_files(kind, spec) -> bool:
    return (kind or spec.source_type or "excel").lower() != "sql"


def retry_quarantined(spark: SparkSession, spec: JobSpec, ledger_path: str, out_dir: str, **job_args):
    """K8: run the job again on the inputs the ledger lists as quarantined (latest run only). Earlier output of other
    files stays, also in the same ``out_dir``."""
    paths = [r["path"] for r in retry_paths(latest(spark.read.parquet(ledger_path))).toLocalIterator() if r["path"]]
    return run_job(spark, spec, paths, out_dir, **job_args) if paths else None


def run_folder(spark: SparkSession, root: str, out_dir: str, load=None, **job_args) -> dict[str, JobResult]:
    """Every file below ``root`` with the spec saved beside it (``pair_specs``), one job per spec over all of its files.

    ``load(path)``: reads a spec (default: through Spark). Files without a spec get a ledger row of status "skipped". The
    company of a file is the first folder below ``root``. Returns the results by spec path.
    """
    import json

    pairs = checkpointed(pair_specs(list_files(spark, root)))
    load = load or (lambda p: JobSpec.from_dict(json.loads("\n".join(r[0] for r in spark.read.text(p, wholetext=True).collect()))))
    out = {}
    for row in pairs.where("spec_path IS NOT NULL").select("spec_path", "ext").distinct().orderBy("spec_path", "ext").collect():
        mine = pairs.where((F.col("spec_path") == row["spec_path"]) & (F.col("ext") == row["ext"]))
        paths = [r["path"] for r in mine.select("path").toLocalIterator()]
        kind = {"csv": "csv", "parquet": "parquet"}.get(row["ext"], "excel")
        out[row["spec_path"] + "|" + row["ext"]] = run_job(spark, load(row["spec_path"]), paths, out_dir, kind=kind, root=root, **job_args)
    skipped = pairs.where("spec_path IS NULL")
    if not skipped.isEmpty():
        rows = skipped.select(plain_path("path").alias("path"), FILE, F.lit("skipped").alias("status"), F.lit("No template found.").alias("message"),
                              F.lit(0).cast("long").alias("rows_in"), F.lit(0).cast("long").alias("rows_out"), F.current_timestamp().alias("run_ts"))
        write_frame(rows, os.path.join(out_dir, "ledger"), "parquet", mode="append")
    return out


def run_job(spark: SparkSession, spec: JobSpec, paths, out_dir: str, kind: str | None = None,
            level: str = "coerce", fail_on_missing: bool = False, fail_on_extra: bool = False,
            guess_header: bool = False, fmt: str = "parquet", company: str | None = None,
            run_ts=None, infer_numbers: bool = True, root: str | None = None, connections: dict | None = None,
            run: str | None = None) -> JobResult:
    """One spec over all its inputs. ``company``: of all files, or the first folder below ``root`` on each file's path. ``run``: the
    outputs go to folders of this run below those of all runs (see ``sinks.commit``)."""
    raw, unreadable = scan_with_errors(spark, spec, paths, kind, guess_header, connections, infer_numbers)
    raw_cols = len([c for c in raw.columns if c not in LINEAGE and c != SHEET])
    t = transform(raw, spec)
    expected = sorted(spec.expected_headers())
    kept = ~F.col(EMPTY) & ~F.col(DATE_MISSING)
    row_local = t.pre_dedupe is None and not spec.combine_on
    if row_local:
        # no group or dedupe: the output rows are the kept rows of the flagged frame, so the whole
        # ledger (counts, failures, presence) comes out of one aggregate next to the write
        scored, lacking_all = with_row_failures(t.flagged, spec, level)
        typed = scored.where(kept).drop(EMPTY, DATE_BAD, DATE_MISSING, NUM_BAD, FAILS)
        fails = [F.sum(F.when(kept, F.col(FAILS)).otherwise(0)).cast("long").alias("errors")]
    else:
        scored = t.flagged
        typed, lacking_all = with_row_failures(t.frame, spec, level)
        fails = []
    keys = file_keys(scored)
    data_cols = [c for c in typed.columns if c not in LINEAGE and c != FAILS]
    by_layout = LAYOUT in scored.columns
    stats = scored.groupBy(*keys, *[LAYOUT] * by_layout).agg(*row_counts(), *fails)
    if by_layout:  # rows are counted by file and layout, so that the names are gathered from few rows
        counts = [c for c in stats.columns if c not in (*keys, LAYOUT)]
        stats = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], F.array_distinct(F.flatten(F.collect_set(LAYOUT))).alias("__names"))
    if not row_local:
        stats = stats.join(typed.groupBy(*keys).agg(F.sum(FAILS).cast("long").alias("errors")), keys, "left")
        typed = typed.drop(FAILS)
    if t.unpivot_info:
        stats = stats.join(raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_rows")), keys, "left")  # K5: before the melt
    else:
        stats = stats.withColumn("raw_rows", F.col("rows_in"))
    listed = lambda names: F.array(*[F.lit(c) for c in names]).cast("array<string>")
    # the columns a file has: those of its layout that are still there, and those the job adds; one schema means all
    names = F.array_union(F.array_intersect("__names", listed(data_cols)), listed([c for c in data_cols if c == "provider_id"])) \
        if by_layout else listed([c for c in data_cols if c in scored.columns])
    missing = F.array_sort(F.array_except(listed(expected), names)) if expected else listed([])
    extra = F.array_sort(F.array_except(names, listed(expected))) if expected else listed([])
    lacking = missing_required(names, spec, level) if by_layout else F.lit(len(lacking_all))
    gate_extra = F.array_except("extra", listed(OWN_COLUMNS))
    ledger = (stats.withColumns({"missing": missing, "extra": extra})
              .withColumn("errors", F.when(lacking > 0, lacking).otherwise(F.coalesce("errors", F.lit(0))).cast("long"))
              .withColumn("drift_failed", (F.lit(fail_on_missing) & (F.size("missing") > 0)) | (F.lit(fail_on_extra) & (F.size(gate_extra) > 0)))
              .withColumn("path", plain_path(KEY)).drop("__names"))
    ledger = _with_all_inputs(spark, ledger, paths, unreadable) if kind_is_files(kind, spec) and paths else ledger.withColumn("unreadable", F.lit(None).cast("string"))
    ledger = ledger.withColumn("is_valid", (F.col("errors") == 0) & F.col("unreadable").isNull())
    reason = (F.when(F.col("unreadable").isNotNull(), F.concat(F.lit("Could not be read: "), "unreadable"))
               .when(~F.col("is_valid"), F.lit("Validation failed."))
               .when(F.col("drift_failed"), F.lit("Schema drift.")))
    ledger = ledger.withColumn("reason", reason).drop("unreadable").withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("processed")).otherwise(F.lit("quarantined")))
    ledger = checkpointed(with_file_id(ledger))          # small, reused by the writes below

    failed = ledger.where(F.col("status") == "quarantined").select(KEY, FILE, "reason")
    clean_path, quarantine_path, ledger_path = (os.path.join(out_dir, name, *([f"run={run}"] if run else [])) for name in ("clean", "quarantine", "ledger"))
    owner = F.lit(company) if company is not None else company_of(plain_path(KEY), root) if root else None
    owned = lambda df: df if owner is None or "company" in df.columns else df.withColumn("company", owner)
    good = owned(where_files(typed, failed, keep=False).drop(LAYOUT, NUMERIC))
    write_clean(good, clean_path, fmt)
    bad = with_file_id(owned(quarantine_rows(raw, failed)))
    write_frame(bad, quarantine_path, fmt, ["company", FILE, "file_id"], only_own_parts=True)

    try:
        written = spark.read.format(fmt).option("header", True).load(clean_path) if fmt == "csv" else \
            spark.read.option("mergeSchema", True).parquet(clean_path)
        amount = F.sum(qc(AMOUNT_FIELD).cast("double")) if AMOUNT_FIELD in good.columns else F.lit(None).cast("double")
        out_counts = written.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(
            F.count(F.lit(1)).alias("rows_out"), amount.alias("amount_out"))
    except AnalysisException:          # every file failed: nothing was written
        out_counts = spark.createDataFrame([], "file_id string, rows_out long, amount_out double")
    done = F.col("status") == "processed"
    result = ledger.join(out_counts, "file_id", "left").withColumns({
        "rows_out": F.when(done, F.coalesce("rows_out", F.lit(0))).otherwise(F.lit(0)).cast("long"), "amount_out": F.when(done, F.col("amount_out"))})
    if t.pre_dedupe is not None:
        before = t.pre_dedupe.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before_dedupe"))
        result = result.join(before, keys, "left").withColumn(
            "dedupe_dropped", F.when(done, F.coalesce("rows_before_dedupe", F.lit(0)) - F.col("rows_out")).otherwise(F.lit(0)).cast("long"))
    else:
        result = result.withColumn("dedupe_dropped", F.lit(0).cast("long"))
    info = t.unpivot_info or {}
    result = (result
              .withColumn("columns_in", F.lit(raw_cols))
              .withColumn("columns_out", F.lit(len(data_cols)))
              .withColumn("unpivot_columns_before", F.lit(info.get("columns_before")).cast("int"))
              .withColumn("unpivot_columns_after", F.lit(info.get("columns_after")).cast("int"))
              .withColumn("message", F.coalesce("reason", F.when(F.col("rows_in") == 0, F.lit("No data rows.")), F.lit("Processing successful.")))
              .withColumn("run_ts", F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp())).drop(KEY, "file_id")
    result = checkpointed(result)
    write_frame(result, ledger_path, "parquet", mode="append")
    total = result.agg(F.coalesce(F.sum("rows_out"), F.lit(0)).alias("rows_written"), F.sum("amount_out").alias("sales_amount_total")).first()
    return JobResult(result, clean_path, quarantine_path, ledger_path, total.asDict())


def _with_all_inputs(spark: SparkSession, ledger: DataFrame, paths, unreadable: DataFrame | None) -> DataFrame:
    """A ledger row for every listed input: those without rows have zeros, and ``unreadable`` has the message of those that could not be read."""
    inputs = list_inputs(spark, paths).withColumnsRenamed({"path": "__p", FILE: "__f"})
    out = ledger.join(inputs, F.col("path") == F.col("__p"), "full")
    zero = ("rows_in", "empty_rows", "date_parse_failures", "numeric_parse_failures", "rows_kept", "raw_rows", "errors")
    out = out.withColumns({"path": F.coalesce("path", "__p"), FILE: F.coalesce(FILE, "__f"), KEY: F.coalesce(KEY, "__p"),
                           "drift_failed": F.coalesce("drift_failed", F.lit(False)), **{c: F.coalesce(c, F.lit(0)) for c in zero},
                           **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("missing", "extra")}}).drop("__p", "__f")
    if unreadable is None:
        return out.withColumn("unreadable", F.lit(None).cast("string"))
    errors = unreadable.select(plain_path("path").alias("__p"), F.coalesce("message", F.lit("")).alias("unreadable")).dropDuplicates(["__p"])
    return out.join(errors, F.col("path") == F.col("__p"), "left").drop("__p")
