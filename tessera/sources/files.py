"""File listings, spec pairing and Parquet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import FILE, KEY, with_file_order
from ..spec import SPEC_MARK, SPEC_SUFFIXES

# Input kinds a drop folder is scanned for.
DATA_SUFFIXES = ("csv", "xlsx", "parquet")


def list_files(spark: SparkSession, root: str, suffixes=DATA_SUFFIXES, recursive: bool = True) -> DataFrame:
    """Every file under ``root`` with name parts and the ``company`` folder.

    ``company`` is the first folder below ``root`` (null for files directly in ``root``, which are
    listed too). The listing reads file metadata only (the content column is never selected).
    """
    root = root.rstrip("/")
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
          .select("path", "length", "modificationTime"))
    name = F.element_at(F.split("path", "/"), -1)
    rel = F.regexp_replace("path", r"^.*?" + _quote(root) + "/", "")
    parts = F.split(rel, "/")
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = df.select(
        "path", name.alias(FILE),
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        F.when(F.size(parts) > 1, F.element_at(parts, 1)).alias("company"),
        ext.alias("ext"),
        F.regexp_replace(name, r"(\.df-template)?\.[^.]+$", "").alias("stem"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if suffixes:
        out = out.where(F.col("ext").isin(*suffixes) | F.col(FILE).contains(SPEC_MARK))
    return out


def _quote(text: str) -> str:
    import re
    return re.escape(text.replace("file:", ""))


def plain_path(column: str):
    """A path as listings, scans and callers all give it: without the local scheme, percent signs decoded."""
    return F.try_url_decode(F.replace(F.regexp_replace(F.col(column), "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def list_inputs(spark: SparkSession, paths) -> DataFrame:
    """(path, source_file) of every input below ``paths``; a folder ``x.parquet`` that a job wrote is one input. Names only are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else list(paths))
    path = plain_path("path")
    folder = F.regexp_extract(path, r"^(.*?\.parquet)/", 1)
    found = files.select(F.when(folder != "", folder).otherwise(path).alias("path")).distinct()
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias(FILE))


def company_of(path, root: str):
    """The first folder below ``root`` on a path (null for files directly in it)."""
    plain = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    return F.nullif(F.regexp_extract(path, "^" + _quote(plain) + "/([^/]+)/", 1), F.lit(""))


def pair_specs(listing: DataFrame) -> DataFrame:
    """Each data file with its spec: ``<stem>.df-template.{json,yaml,yml}`` in the same folder,
    else the first spec of the folder (by name; json before yaml before yml). Unpaired files keep
    a null ``spec_path`` (the ledger marks them skipped)."""
    is_spec = F.col(FILE).contains(SPEC_MARK)
    specs = listing.where(is_spec).select(
        "dir", "stem", F.col("path").alias("spec_path"),
        F.array_position(F.array(*[F.lit(s) for s in SPEC_SUFFIXES]), F.col("ext")).alias("rank"), FILE)
    data = listing.where(~is_spec)
    exact = specs.groupBy("dir", "stem").agg(F.min_by("spec_path", "rank").alias("exact_spec"))
    first = specs.groupBy("dir").agg(F.min_by("spec_path", F.struct("rank", FILE)).alias("folder_spec"))
    return (data.join(exact, ["dir", "stem"], "left").join(first, "dir", "left")
            .withColumn("spec_path", F.coalesce("exact_spec", "folder_spec"))
            .drop("exact_spec", "folder_spec"))


def read_parquet(spark: SparkSession, paths, lineage: bool = True) -> DataFrame:
    """S5 (+ S14): Parquet files with ``source_file`` and row order; columns of all files, by name."""
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    return with_file_order(df) if lineage else df


def preflight(spark: SparkSession, listing: DataFrame, rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A10: per listed file, its data rows and columns and a status: OK, Empty, or the decode
    error (``errors``: ``source_file, message`` as from ``workbook.decode_errors``)."""
    from ..operators.aggregate import file_sizes
    sizes = file_sizes(rows)
    if "source_sheet" in sizes.columns:
        sizes = sizes.groupBy(*[c for c in (KEY, FILE) if c in sizes.columns]).agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"))
    on = KEY if KEY in sizes.columns else FILE      # names repeat across folders, paths don't
    out = listing.select("path", FILE, plain_path("path").alias(KEY))
    out = out.join(sizes.withColumn(on, plain_path(on)).drop(FILE if on == KEY else KEY), on, "left")
    status = F.when(F.col("rows") > 0, F.lit("OK")).otherwise(F.lit("Empty"))
    if errors is not None:
        out = out.join(errors.select(plain_path("path").alias(KEY), F.col("message").alias("__err")), KEY, "left")
        status = F.when(F.col("__err").isNotNull(), F.concat(F.lit("error: "), F.col("__err"))).otherwise(status)
    out = out.withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("columns", F.coalesce("columns", F.lit(0)))
    return out.withColumn("status", status).drop("__err", KEY)
