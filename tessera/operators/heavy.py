"""Frequent values without shuffling every value: Misra-Gries summaries of the tasks' rows, added up, then exact counts of the
candidates.

A task keeps at most ``counters`` values with counts that are too low by no more than what it wrote off, so a summary's size does
not depend on the rows. Added up over the tasks, a value's true count lies between its sum and the sum plus all that was written off.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

COUNTERS = 65_536


def _summary(counters: int):
    def run(batches):
        held, off = Counter(), 0
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                held[pair["values"]] += pair["counts"]
            if len(held) > 2 * counters:
                cut = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -counters - 1)[-counters - 1])
                held, off = Counter({v: c - cut for v, c in held.items() if c > cut}), off + cut
        held.pop(None, None)
        rows = list(held.items()) + [(None, off)]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["value", "low"])
    return run


def summaries(df: DataFrame, value, counters: int = COUNTERS) -> tuple[DataFrame, int]:
    """(value as text, low) of every value some task kept, and how far ``low`` may be below the count (also of values not
    listed, whose ``low`` is 0). Nulls are not counted."""
    parts = df.select(value.cast("string").alias("value")).mapInArrow(_summary(counters), "value string, low long")
    both = checkpointed(parts.groupBy("value").agg(F.sum("low").alias("low")))
    off = both.where("value IS NULL").select("low").first()
    return both.where("value IS NOT NULL"), int(off[0]) if off else 0


def most_frequent(df: DataFrame, value, k: int, counters: int = COUNTERS) -> DataFrame | None:
    """Values (as text) that may be among the ``k`` most frequent, all of those that are; None where what the tasks wrote off leaves it open."""
    found, off = summaries(df, value, counters)
    least = [r[0] for r in found.orderBy(F.desc("low")).limit(k).select("low").collect()]
    if off and (len(least) < k or least[-1] <= off):
        return None
    return found.where(F.col("low") + off >= (least[-1] if len(least) == k else 0)).select("value")
