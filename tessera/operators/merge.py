"""J1-J4 over many inputs at once: one exchange for all of them, and keys of any size split over tasks.

The rows of all inputs, tagged by input, are grouped by key (null keys are one key, as everywhere in merges). What a left fold of joins gives for a
key follows from which inputs have it and their rows there, so the product is written out from those runs, without a join a step.

A key with more than ``crowd`` rows in one input (found by summaries of the tasks, then counted exactly) is divided: each input's rows of
the key are dealt into chunks, and every combination of one chunk per input is a group of its own. The rows of a chunk are repeated
once per combination of the others' chunks, which is less than the rows of the product by a factor of ``crowd`` or more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed
from .combine import HOW, missing_keys, widest
from .heavy import COUNTERS, summaries
from .lineage import qc

TAG, CELL, ROW = "__tag", "__cell", "__row"


def merged_names(frames: list[DataFrame], keys: list[str]) -> list[dict]:
    """Per frame, source column -> result column: a name that earlier frames took gets ``_i`` (i from 2)."""
    taken, out = set(frames[0].columns), [{c: c for c in frames[0].columns if c not in keys}]
    for i, f in enumerate(frames[1:], 2):
        out.append({c: f"{c}_{i}" if c in taken else c for c in f.columns if c not in keys})
        taken |= set(out[-1].values())
    return out


def takes_part(has: list[Column], how: str) -> list[Column]:
    """Whether each input's rows appear for a key, given which inputs have it."""
    if how == "inner":
        return [reduce(lambda a, b: a & b, has)] * len(has)
    if how == "left":
        return [has[0]] + [has[0] & h for h in has[1:]]
    if how == "right":  # a step keeps earlier rows only where all inputs since then have the key
        return [reduce(lambda a, b: a & b, has[i:]) for i in range(len(has))]
    return has


def _tagged(frames, keys):
    types = {k: {f.schema[k].dataType.simpleString(): f.schema[k].dataType for f in frames} for k in keys}
    cast = {k: widest(t.values()) if len(t) > 1 else next(iter(t)) for k, t in types.items()}
    kinds = [StructType([x for x in f.schema.fields if x.name not in keys]).simpleString() for f in frames]

    def one(i, f):
        own = [qc(c) for c in f.columns if c not in keys]
        rows = [(F.struct(*own) if own else F.struct(F.lit(True).alias("there"))) if j == i else
                F.lit(None).cast(kinds[j] if kinds[j] != "struct<>" else "struct<there:boolean>") for j in range(len(frames))]
        return f.select(*[qc(k).cast(cast[k]).alias(k) for k in keys], F.lit(i).alias(TAG), *[r.alias(f"{ROW}{j}") for j, r in enumerate(rows)])

    return reduce(lambda a, b: a.unionByName(b), [one(i, f) for i, f in enumerate(frames)])


def crowded_keys(tagged: DataFrame, keys: list[str], n: int, how: str, crowd: int, counters: int = COUNTERS) -> DataFrame | None:
    """Keys with more than ``crowd`` rows in one input: (keys, chunks: chunks of each input, takes: which inputs appear)."""
    code = F.xxhash64(*[qc(k) for k in keys], *[qc(k).isNull() for k in keys])
    found, off = summaries(tagged, code, counters)  # of all inputs together, so none is missed
    found = found.where(F.col("low") + off > crowd).select(F.col("value").cast("long").alias("__code"))
    if off <= crowd and found.isEmpty():
        return None
    rows = tagged.select(*[qc(k) for k in keys], TAG)
    rows = rows.where(code.isNotNull()).join(found, code == found["__code"], "left_semi") if off <= crowd else rows
    counts = rows.groupBy(*[qc(k) for k in keys]).agg(*[F.count(F.when(F.col(TAG) == i, 1)).alias(f"n{i}") for i in range(n)])
    counts = counts.where(F.greatest(*[F.col(f"n{i}") for i in range(n)], F.lit(0)) > crowd)
    takes = takes_part([F.col(f"n{i}") > 0 for i in range(n)], how)
    chunks = [F.when(t, F.ceil(F.col(f"n{i}") / crowd)).otherwise(1).cast("long") for i, t in enumerate(takes)]
    out = checkpointed(counts.select(*[qc(k) for k in keys], F.array(*chunks).alias("__chunks"), F.array(*takes).alias("__takes")))
    return None if out.isEmpty() else out


def _dealt(tagged: DataFrame, keys, heavy: DataFrame, n: int) -> DataFrame:
    """Rows of crowded keys in their chunk, once per combination of the other inputs' chunks; other rows stay."""
    heavy = heavy.select(*[qc(k).alias(f"__h_{k}") for k in keys], "__chunks", "__takes")
    same = reduce(lambda a, b: a & b, [qc(k).eqNullSafe(qc(f"__h_{k}")) for k in keys])
    rows = tagged.withColumn("__at", F.monotonically_increasing_id()).join(heavy, same, "left")
    rows = rows.where(F.coalesce(F.col("__takes")[F.col(TAG)], F.lit(True)))
    times = lambda a, b: F.aggregate(F.slice("__chunks", a, b), F.lit(1).cast("long"), lambda x, y: x * y)
    stride, own = times(F.lit(1), F.col(TAG)), F.col("__chunks")[F.col(TAG)]
    behind = times(F.col(TAG) + 2, F.lit(n))
    mine = F.pmod(F.col("__at"), own)
    cells = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), behind - 1), lambda b: F.transform(
        F.sequence(F.lit(0).cast("long"), stride - 1), lambda a: (b * own + mine) * stride + a)))
    cells = F.when(F.col("__chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)
    return rows.select(*tagged.columns, "__takes", F.explode(cells).alias(CELL))


def merge_many(frames: list[DataFrame], keys, how: str = "inner", crowd: int = 10_000, counters: int = COUNTERS) -> DataFrame:
    """The left fold of key merges (as ``merge_frames``) of any number of inputs, in one exchange.

    Null keys match each other; key columns of several types are compared in the type that holds them all; the i-th
    frame's clashing columns get ``_i``. ``right`` keeps all rows of the last input, ``outer`` those of all.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("Merge mode requires at least one key.")
    if how not in HOW:
        raise ValueError(f"unknown merge type {how}")
    for i, f in enumerate(frames):
        if miss := missing_keys(f.columns, keys):
            raise ValueError(f"Missing merge keys. Input {i + 1} lacks {miss}.")
    n, names = len(frames), merged_names(frames, keys)
    tagged = _tagged(frames, keys)
    heavy = crowded_keys(tagged, keys, n, how, crowd, counters)
    dealt = _dealt(tagged, keys, heavy, n) if heavy is not None else tagged.withColumn(CELL, F.lit(0).cast("long"))
    runs = [F.collect_list(f"{ROW}{i}").alias(f"{ROW}{i}") for i in range(n)]
    takes = [F.first("__takes").alias("__takes")] if heavy is not None else []
    groups = dealt.groupBy(*[qc(k) for k in keys], CELL).agg(*runs, *takes)
    there = [F.size(f"{ROW}{i}") > 0 for i in range(n)]
    part = takes_part(there, how)
    if heavy is not None:  # in a cell, an input may have no row although the key has
        whole = reduce(lambda a, b: a & b, [~F.col("__takes")[i] | there[i] for i in range(n)])
        groups = groups.where(F.col("__takes").isNull() | whole)
        part = [F.coalesce(F.col("__takes")[i], part[i]) for i in range(n)]
    groups = groups.where(reduce(lambda a, b: a | b, part))
    groups = groups.select(*[qc(k) for k in keys], *[F.when(p, F.col(f"{ROW}{i}")).alias(f"{ROW}{i}") for i, p in enumerate(part)])
    for i in range(n):
        groups = groups.select(*[qc(c) for c in groups.columns if c != f"{ROW}{i}"], F.explode_outer(f"{ROW}{i}").alias(f"{ROW}{i}"))
    first = [qc(c) if c in keys else F.col(f"{ROW}0")[c].alias(c) for c in frames[0].columns]
    return groups.select(*first, *[F.col(f"{ROW}{i}")[c].alias(name) for i in range(1, n) for c, name in names[i].items()])
