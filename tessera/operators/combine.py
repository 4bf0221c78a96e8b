"""U1-U3 stacking and J1-J6 key merges of many outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, NumericType

from ..operators.lineage import qc

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def widest(types) -> str:
    """One type for columns of several: whole numbers become long, numbers of any kind double, anything else text."""
    kinds = [t for t in types if not isinstance(t, NullType)]
    if all(isinstance(t, IntegralType) for t in kinds):
        return "long"
    return "double" if all(isinstance(t, NumericType) for t in kinds) else "string"


def stack_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union by column name, first-seen column order, missing columns null.

    A column whose type differs between frames gets the type that holds them all (``widest``); numbers stay numbers.
    """
    if not frames:
        raise ValueError("nothing to stack")
    types: dict[str, list] = {}
    for f in frames:
        for field in f.schema.fields:
            types.setdefault(field.name, []).append(field.dataType)
    wide = {c: widest(t) for c, t in types.items() if len({x.simpleString() for x in t}) > 1}
    if wide:
        frames = [f.withColumns({c: qc(c).cast(wide[c]) for c in f.columns if c in wide}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_strict(frames: list[DataFrame], labels: list[str] | None = None) -> DataFrame:
    """Every frame must have the first frame's column names in the same order."""
    if not frames:
        raise ValueError("nothing to stack")
    labels = labels or [f"#{i + 1}" for i in range(len(frames))]
    base = frames[0].columns
    for f, label in zip(frames[1:], labels[1:]):
        if f.columns != base:
            raise ValueError(f"Schema mismatch in {label}")
    return reduce(lambda a, b: a.union(b), frames)


def missing_keys(columns: list[str], keys: list[str]) -> list[str]:
    return [k for k in keys if k not in columns]


def check_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Error naming the keys missing on either side."""
    ml, mr = missing_keys(left.columns, keys), missing_keys(right.columns, keys)
    if ml or mr:
        raise ValueError(f"Missing merge keys. Left missing {ml}, right missing {mr}.")


def missing_key_report(schemas: dict[str, list[str]], keys: list[str], show: int = 5) -> list[dict]:
    """Per file, the merge keys it lacks (first ``show`` named in the message)."""
    rows = []
    for label, cols in schemas.items():
        miss = missing_keys(cols, keys)
        if miss:
            more = "..." if len(miss) > show else ""
            rows.append({"file": label, "missing": miss,
                         "message": f"{label}: missing {', '.join(miss[:show])}{more}"})
    return rows


def missing_keys_by_file(df: DataFrame, keys: list[str], show: int = 5) -> DataFrame:
    """J6 over a stacked frame: per file, the merge keys it lacks (see ``columns_by_file``), with a message naming the
    first ``show``. One aggregate pass."""
    from .lineage import FILE
    from .validate import columns_by_file
    counts, present = columns_by_file(df), F.col("present")
    missing = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: ~F.array_contains(present, k))
    out = counts.select(FILE, missing.alias("missing"))
    more = F.when(F.size("missing") > show, F.lit("...")).otherwise(F.lit(""))
    return out.where(F.size("missing") > 0).select(
        FILE, F.array_join("missing", ",").alias("missing"),
        F.concat(F.col(FILE), F.lit(": missing "), F.array_join(F.slice("missing", 1, show), ", "), more)
         .alias("message"))


def merge_two(left: DataFrame, right: DataFrame, keys: list[str], how: str, suffix: str) -> DataFrame:
    """One merge step: null keys match each other; overlapping right columns get ``suffix``."""
    check_keys(left, right, keys)
    join_type = HOW[how]
    overlap = {c for c in right.columns if c in left.columns and c not in keys}
    r = right.select(*[qc(c).alias(f"__r_{c}") if c in keys else
                       qc(c).alias(f"{c}{suffix}" if c in overlap else c) for c in right.columns])
    mine = left.withColumnsRenamed({c: f"__l_{c}" for c in left.columns})
    cond = reduce(lambda a, b: a & b, [qc(f"__l_{k}").eqNullSafe(qc(f"__r_{k}")) for k in keys])
    joined = mine.join(r, cond, join_type)
    key = {"right": lambda k: qc(f"__r_{k}"), "full": lambda k: F.coalesce(qc(f"__l_{k}"), qc(f"__r_{k}"))}.get(
        join_type, lambda k: qc(f"__l_{k}"))
    right_rest = [qc(f"{c}{suffix}" if c in overlap else c) for c in right.columns if c not in keys]
    # output order: left columns with the keys in place, then the right side's non-key columns
    return joined.select(*[(key(c) if c in keys else qc(f"__l_{c}")).alias(c) for c in left.columns], *right_rest)


def merge_frames(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Left fold of key merges; the i-th frame's clashing columns get ``_i`` (i from 2).

    Each step is an equi-join on the keys, so Spark hash-partitions once on them; a side whose
    size statistics fall under the broadcast threshold is broadcast by the planner, and AQE splits
    a key partition that is skewed.
    """
    if not keys:
        raise ValueError("Merge mode requires at least one key.")
    if how not in HOW:
        raise ValueError(f"unknown merge type {how}")
    merged = frames[0]
    for idx, df in enumerate(frames[1:], start=2):
        merged = merge_two(merged, df, list(keys), how, f"_{idx}")
    return merged
