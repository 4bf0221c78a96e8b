"""Registered queries: each operator of the inventory run over the driver's tables.

Every query reads whole tables (or frames Spark derives from them) and returns a DataFrame whose
column names equal those of the matching DuckDB SQL in ``ORACLE``. Messy inputs (text numbers,
bad dates, null keys, banner rows) are derived from the tables by expressions on their values,
so the work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import with_file_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str, lineage: bool = False) -> DataFrame:
    """A driver table."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return with_file_order(df) if lineage else df


def r2(c) -> "F.Column":
    return F.round(c, 2)
