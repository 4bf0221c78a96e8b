"""A drop folder processed incrementally with Structured Streaming.

New files are picked up by a file stream over ``binaryFile`` (paths only are used); each
micro-batch runs the batch job on exactly the files it brought. ``cleanSource=archive`` moves
processed inputs to the archive folder (Spark archives a file once a later batch has committed,
so archiving lags one trigger). The checkpoint folder makes the stream restartable after executor
or driver loss: a batch that did not commit is run again on the same files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

import pandas as pd
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.job import run_job
from ..session import scratch_path
from ..sinks.commit import run_committed
from ..spec import JobSpec


def start_incremental(spark: SparkSession, spec: JobSpec, in_dir: str, out_dir: str,
                      archive_dir: str | None = None, checkpoint: str | None = None,
                      pattern: str | None = None, available_now: bool = True, kind: str | None = None,
                      max_files_per_trigger: int | None = 1000, **job_args):
    """Start the stream; returns the ``StreamingQuery``."""
    checkpoint = checkpoint or scratch_path(spark, "stream-" + os.path.basename(in_dir.rstrip("/")))
    files = _arrivals(spark, in_dir, archive_dir, pattern, max_files_per_trigger).select("path")

    def handle(batch: DataFrame, epoch: int) -> None:
        # the micro-batch is a bounded list of new file paths (at most maxFilesPerTrigger), the
        # only thing that passes through the driver; the files themselves are read by the job
        paths = sorted(r["path"] for r in batch.collect())
        if not paths:
            return
        run_job(spark, spec, paths, os.path.join(out_dir, f"batch={epoch}"), kind=kind, **job_args)

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _arrivals(spark, in_dir, archive_dir, pattern, max_files_per_trigger) -> DataFrame:
    """(path, modificationTime, length) of files as they come."""
    reader = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length long, content binary")
              .option("recursiveFileLookup", True))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(in_dir).select("path", "modificationTime", "length")


def _unseen(key, frames, state):
    """Of the sightings of one path, those with a modification time or length it did not have last; the state keeps the last."""
    last = state.get if state.exists else None
    for pdf in frames:
        for at, length in sorted({(int(t.value), int(n)) for t, n in zip(pdf["modificationTime"], pdf["length"])}):
            if last is None or (at, length) != last and at >= last[0]:
                last = (at, length)
                yield pd.DataFrame({"path": [key[0]], "modified": [at], "length": [length]})
    if last is not None:
        state.update(last)


def unseen_files(arrivals: DataFrame) -> DataFrame:
    """(path, modified in nanoseconds, length) of files that come for the first time or changed. The state, one small row per
    path, lives in the stream's checkpoint."""
    return arrivals.groupBy("path").applyInPandasWithState(
        _unseen, "path string, modified long, length long", "modified long, length long", "append", GroupStateTimeout.NoTimeout)


def commit_batch(spark: SparkSession, spec: JobSpec, batch: DataFrame, out_dir: str, key: str, **job_args) -> bool:
    """One batch of files as one committed run. A batch that is handed in again is found published and left alone."""
    paths = sorted({r["path"] for r in batch.select("path").collect()})  # at most maxFilesPerTrigger
    return bool(paths) and run_committed(spark, spec, paths, out_dir, key, **job_args)


def start_committed(spark: SparkSession, spec: JobSpec, in_dir: str, out_dir: str, checkpoint: str, archive_dir: str | None = None,
                    pattern: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = 1000, **job_args):
    """``start_incremental`` whose outputs take every file once: sightings of a file are remembered by path, modification time and
    length, and a batch's tables are published together, once (read them with ``sinks.commit.published``)."""
    files = unseen_files(_arrivals(spark, in_dir, archive_dir, pattern, max_files_per_trigger))
    stream = os.path.basename(checkpoint.rstrip("/"))

    def handle(batch: DataFrame, epoch: int) -> None:
        commit_batch(spark, spec, batch.persist(), out_dir, f"{stream}/{epoch}", **job_args)
        batch.unpersist()

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
