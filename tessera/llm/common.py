"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: later uses neither
    recompute it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(id_col="doc_id"):
    """True for rows whose crc32 of the id as text leaves 2 when divided by 4. A null id counts as held out:
    nothing is learnt from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def byte_batches(batches, limit: int = 8 << 20):
    """Arrow record batches cut so that none holds much more than ``limit`` bytes (one row may)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def sample_per_class(rows: DataFrame, class_col: str, id_col: str, n: int) -> DataFrame:
    """About ``n`` rows of each class, and never more than twice ``n`` times the classes: a row is taken if a
    hash of its id falls below the share its class needs, so reruns take the same rows."""
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for c, k in counts.items() for x in (c, min(1.0, n / k))])
    u = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(F.col(class_col).isNotNull() & (u < share[F.col(class_col)])).limit(2 * n * len(counts))
