"""Runs whose outputs appear together: clean rows, quarantine and ledger of a run lie in folders of the run, and one manifest row,
written last, makes them count. What a run left behind that did not get that far is never read.

A run has a key (a batch of a stream, a day, a folder). A key is published once: the same work done again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import job
from ..spec import JobSpec

TABLES = ("clean", "quarantine", "ledger")
MANIFEST = "run_key string, run string"


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """(run_key, run) of the runs that count. A manifest is one file, which Spark's commit moves into place in one step."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{out_dir}/published")
        return rows.groupBy("run_key").agg(F.min("run").alias("run"))
    except AnalysisException:  # nothing published yet
        return spark.createDataFrame([], MANIFEST)


def published(spark: SparkSession, out_dir: str, table: str) -> DataFrame | None:
    """Rows of all runs that count (``run`` tells them apart; None if no run wrote that table)."""
    try:
        rows = spark.read.option("mergeSchema", True).parquet(f"{out_dir}/{table}")
    except AnalysisException:
        return None
    return rows.join(manifest(spark, out_dir).select("run"), "run", "left_semi")


def is_published(spark: SparkSession, out_dir: str, key: str) -> bool:
    return not manifest(spark, out_dir).where(F.col("run_key") == key).isEmpty()


def run_committed(spark: SparkSession, spec: JobSpec, paths, out_dir: str, key: str, **job_args) -> bool:
    """The job over ``paths`` as run ``key``; False, and nothing done, if that key is published.

    Whatever step it dies in, a rerun leaves the same three tables as a run that went through.
    """
    if is_published(spark, out_dir, key):
        return False
    run = uuid.uuid4().hex
    job.run_job(spark, spec, paths, out_dir, run=run, **job_args)
    spark.createDataFrame([(key, run)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{out_dir}/published/{uuid.uuid5(uuid.NAMESPACE_URL, key).hex}")
    return True
