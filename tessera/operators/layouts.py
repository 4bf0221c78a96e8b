"""Date layouts told from the data, file by file and column by column.

Texts such as 03/04/2024 do not say which number is the day. One mergeable summary per file and column counts how many of its texts
read as dates either way; a number over 12 anywhere in the column settles it for all of them. Texts that name the month, or begin
with the year, need no decision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import MONTH_ABBREVIATIONS, month_token
from ..session import checkpointed
from .lineage import file_keys, qc

CLOCK = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
NUMBERS = r"^(\d{1,4})[-/. ]+(\d{1,2})[-/. ]+(\d{1,4})\.?" + CLOCK + "$"
DAY_WORD = r"^(\d{1,2})[-/. ]*(\p{L}+)[-/., ]*(\d{4}|\d{2})" + CLOCK + "$"
WORD_DAY = r"^(\p{L}+)[-/. ]*(\d{1,2})[-/., ]+(\d{4}|\d{2})" + CLOCK + "$"
TURN = 69  # two-digit years below it are of this century


def _group(t: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("int")


def _year(t: Column, pattern: str, k: int) -> Column:
    digits, n = F.regexp_extract(t, pattern, k), _group(t, pattern, k)
    return F.when(F.length(digits) == 4, n).when(F.length(digits) == 2, n + F.when(n < TURN, 2000).otherwise(1900))


def _clean(c: Column) -> Column:
    return F.trim(c.cast("string"))


def _open(t: Column) -> tuple[Column, Column]:
    """The two numbers in front of the year, where a text has them; null elsewhere."""
    asks = t.rlike(NUMBERS) & (F.length(F.regexp_extract(t, NUMBERS, 1)) <= 2)
    return tuple(F.when(asks, _group(t, NUMBERS, k)) for k in (1, 2))


def parse_by_layout(c: Column, day_first: Column) -> Column:
    """``timestamp_ntz`` of a text; ``day_first`` decides where two numbers stand in front of the year. Texts of no known shape and days
    that no month has give null."""
    def of(t):
        month_of = lambda k, p: F.nullif(F.array_position(F.array(*map(F.lit, MONTH_ABBREVIATIONS)), month_token(F.regexp_extract(t, p, k))), F.lit(0)).cast("int")
        clock = lambda p: [F.coalesce(_group(t, p, k), F.lit(0)) for k in (4, 5)] + [F.coalesce(_group(t, p, 6), F.lit(0)).cast("decimal(16,6)")]
        make = lambda y, m, d, p: F.try_make_timestamp_ntz(y, m, d, *clock(p))
        a, b = _group(t, NUMBERS, 1), _group(t, NUMBERS, 2)
        late = F.length(F.regexp_extract(t, NUMBERS, 1)) <= 2
        numbers = F.when(late, make(_year(t, NUMBERS, 3), F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b), NUMBERS)).when(
            F.length(F.regexp_extract(t, NUMBERS, 1)) == 4, make(a, b, _group(t, NUMBERS, 3), NUMBERS))
        return (F.when(t.rlike(NUMBERS), numbers).when(t.rlike(DAY_WORD), make(_year(t, DAY_WORD, 3), month_of(2, DAY_WORD), _group(t, DAY_WORD, 1), DAY_WORD))
                .when(t.rlike(WORD_DAY), make(_year(t, WORD_DAY, 3), month_of(1, WORD_DAY), _group(t, WORD_DAY, 2), WORD_DAY)))
    return F.transform(F.array(_clean(c)), of)[0]


def date_layouts(df: DataFrame, columns: list[str], day_first: bool = False) -> DataFrame:
    """(file, column, as_day_first, as_month_first, day_first) per file and text column, in one aggregate: how many texts are dates read
    either way, and the way that reads more (``day_first`` where both read as many)."""
    keys = file_keys(df)
    aggs = []
    for i, c in enumerate(columns):
        a, b = _open(_clean(qc(c)))
        aggs += [F.count_if((b <= 12) & a.between(1, 31)).alias(f"d{i}"), F.count_if((a <= 12) & b.between(1, 31)).alias(f"m{i}")]
    stats = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    each = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("as_day_first"), F.col(f"m{i}").alias("as_month_first")) for i, c in enumerate(columns)]
    out = stats.select(*keys, F.inline(F.array(*each)))
    way = F.when(F.col("as_day_first") != F.col("as_month_first"), F.col("as_day_first") > F.col("as_month_first")).otherwise(F.lit(day_first))
    return out.withColumn("day_first", way)


def parse_dates(df: DataFrame, columns: list[str], day_first: bool = False, suffix: str = "") -> DataFrame:
    """``columns`` of text as ``timestamp_ntz``, each in the layout of its file (``suffix``: into new columns). One small table, a row
    per file, is joined, and none where all files agree."""
    columns = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    if not columns:
        return df
    keys = file_keys(df)
    found = checkpointed(date_layouts(df, columns, day_first))
    ways = {r["column"]: r["w"] for r in found.groupBy("column").agg(F.collect_set("day_first").alias("w")).collect()}
    parsed = {}
    if mixed := [c for c in columns if len(ways.get(c, ())) > 1]:
        wide = found.groupBy(*keys).agg(*[F.bool_or(F.when(F.col("column") == c, F.col("day_first"))).alias(f"__way{i}") for i, c in enumerate(mixed)])
        same = reduce(lambda a, b: a & b, [qc(k).eqNullSafe(F.col(f"__f_{k}")) for k in keys])
        df = df.join(wide.withColumnsRenamed({k: f"__f_{k}" for k in keys}), same, "left").drop(*[f"__f_{k}" for k in keys])
    for c in columns:
        way = F.col(f"__way{mixed.index(c)}") if c in mixed else F.lit(bool(ways[c][0]) if ways.get(c) else day_first)
        parsed[c + suffix] = parse_by_layout(qc(c), F.coalesce(way, F.lit(day_first)))
    return df.withColumns(parsed).drop(*[f"__way{i}" for i in range(len(mixed))])
