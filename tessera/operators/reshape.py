"""Unpivot (wide months to long rows)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .combine import widest
from .lineage import LAYOUT, LINEAGE, NUMERIC, ORD, qc

log = logging.getLogger(__name__)


def unpivot(df: DataFrame, ids: list[str], var_name: str, value_name: str, carry=()):
    """Melt every non-id column into ``(var_name, value_name)`` rows; nulls are kept. ``carry`` names columns that go along
    unchanged without being data.

    Returns ``(frame, shape_before, shape_after)`` where shapes are ``(rows, columns)`` as lazy
    counts are not taken here: rows are given as ``None`` and the caller's ledger fills them.
    The new ``__ord`` sorts like a melt: value column first, then input order.
    """
    present = [c for c in ids if c in df.columns]
    if not present:
        log.warning("unpivot requested but no identifier columns found")
        return df, None
    lineage = [c for c in (*LINEAGE, *carry) if c in df.columns]
    values = [c for c in df.columns if c not in present and c not in lineage]
    if not values:
        return df, None
    # one value type per column in Spark: mixed inputs get the type that holds them all
    types = {df.schema[c].dataType.simpleString(): df.schema[c].dataType for c in values}
    cast_to = None if len(types) == 1 else widest(types.values())
    src = df
    if NUMERIC in lineage and LAYOUT in lineage:
        # the molten value is a number in a file whose value columns all are
        from pyspark.sql.types import NumericType
        texts = F.array(*[F.lit(c) for c in values if not isinstance(df.schema[c].dataType, NumericType)]).cast("array<string>")
        odd = F.array_except(F.array_intersect(LAYOUT, texts), NUMERIC)
        now = F.when(F.size(odd) == 0, F.array(F.lit(value_name))).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(NUMERIC, now)
        src = df = df.select(*[c for c in df.columns if c != NUMERIC], F.col(NUMERIC).alias(NUMERIC, metadata={"columns": [value_name]}))
    if cast_to:
        src = df.select(*[qc(c) for c in present + lineage],
                        *[qc(c).cast(cast_to).alias(c) for c in values])
    out = src.unpivot(present + lineage, values, var_name, value_name)
    if LAYOUT in lineage:
        # a stacked frame: a file only melts the columns it has
        out = out.where(F.array_contains(F.col(LAYOUT), F.col(var_name)))
        out = out.withColumn(LAYOUT, F.array_union(F.array_intersect(LAYOUT, F.array(*[F.lit(c) for c in present])),
                                                  F.array(F.lit(var_name), F.lit(value_name))))
    if ORD in lineage:
        index = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        out = out.withColumn(ORD, F.struct(F.try_element_at(index, F.col(var_name)).alias("v"),
                                           F.col(ORD).alias("o")))
    info = {"value_columns": values, "id_columns": present,
            "columns_before": len(present) + len(values), "columns_after": len(present) + 2}
    return out, info
