"""M1-M5: header-row guess, synonym mapping and header candidates over a corpus of files.

Inputs are long tables: cells ``(source_file, row, col, value, kind)`` and headers
``(source_file, ordinal, header)``; every step is a grouped aggregate, a join or a per-row helper,
so nothing holds a whole file in one place except where a file's width bounds it.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import header_norm, snake_case, trim_ws, year_month_label
from .lineage import FILE, file_keys

# Header-row heuristic thresholds.
TEXT_SHARE = 0.8
FILL_SHARE = 0.5
# Similarity cut-offs (close match for auto-mapping, best target for suggestions).
CLOSE_CUTOFF = 0.82
BEST_CUTOFF = 0.6


# ---------------------------------------------------------------------------------------------
# M1

def header_row_guess(cells: DataFrame, scope=(FILE,), max_rows: int | None = None) -> DataFrame:
    """First row whose non-null cells are > 80 % text and fill > 50 % of the width; else 0.

    ``cells``: one row per cell with ``row``, ``col``, ``value`` and ``kind`` ('text' for text,
    anything else for numbers, dates, booleans). Width is the widest row of the file. With
    ``max_rows`` only rows below that index are considered (a preview window).
    """
    scope = list(scope)
    c = cells if max_rows is None else cells.where(F.col("row") < max_rows)
    there = F.col("value").isNotNull()
    stats = c.groupBy(*scope, "row").agg(F.sum(there.cast("long")).alias("filled"), F.sum((there & (F.col("kind") == "text")).cast("long")).alias("texts"),
                                         (F.max("col") + 1).alias("w"))
    return first_header_row(stats, scope)


def first_header_row(stats: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, header_row) from (scope, row, filled, texts, w): per file the first row with a text share > 0.8 and a fill > 0.5 of the
    file's own width, else 0.

    Text-heavy rows are first reduced to the lowest row per (file, fill count), a table bounded by
    the width of a file; only that small table meets the per-file width. Both aggregates combine
    per task before the shuffle, so a file holding a third of all rows costs no single hot task.
    """
    width = stats.groupBy(*scope).agg(F.max("w").alias("width"))
    heavy = stats.where((F.col("filled") > 0) & (F.col("texts") / F.col("filled") > TEXT_SHARE))
    by_fill = heavy.groupBy(*scope, "filled").agg(F.min("row").alias("row"))
    first = (by_fill.join(width, scope).where(F.col("filled") / F.col("width") > FILL_SHARE)
             .groupBy(*scope).agg(F.min("row").alias("header_row")))
    return width.select(*scope).join(first, scope, "left").select(*scope, F.coalesce("header_row", F.lit(0)).alias("header_row"))


# ---------------------------------------------------------------------------------------------
# M2


# Rough bounds in the JVM leave few pairs to the exact ratio, which is a small Arrow-batched helper.


@F.pandas_udf(DoubleType())
def _ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Share of matching characters of two texts, as ``difflib`` counts them."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second)], dtype="float64")


def _may_reach(a, b, cutoff: float):
    """The ratio 2 * matches / (length of both) cannot reach the cutoff unless the texts have enough characters in common."""
    both = F.length(a) + F.length(b)
    chars = F.array_distinct(F.split(a, ""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(chars, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    short = 2 * F.least(F.length(a), F.length(b)) >= cutoff * both - 1e-9
    return F.when(short, 2 * common >= cutoff * both - 1e-9).otherwise(F.lit(False))


def _term_rows(synonyms: dict, form=lambda c: c):
    """All (target position, position, term) of a synonym configuration as one literal array: the targets' own names come first."""
    listed = [(t, term) for t, (name, terms) in enumerate(synonyms.items()) for term in (name, *terms)]
    return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), form(F.lit(str(term))).alias("term"))
                     for k, (t, term) in enumerate(listed)])


def _texts_with_terms(headers: DataFrame, header_col: str, synonyms: dict, form=lambda c: c) -> DataFrame:
    """Each distinct header text beside each term of the configuration."""
    texts = headers.select(F.col(header_col).alias("__h")).where(F.col("__h").isNotNull()).distinct()
    return texts.withColumn("term", F.explode(_term_rows(synonyms, form))).select("__h", "term.*")


def _target_names(synonyms: dict):
    return F.array(*[F.lit(t) for t in synonyms])


def substring_hits(headers: DataFrame, synonyms: dict, header_col: str = "header") -> DataFrame:
    """Per header the targets with a term contained in it (case-blind); no Python."""
    pairs = _texts_with_terms(headers, header_col, synonyms)
    low = trim_ws(F.lower(F.col("__h")))
    hits = pairs.where((F.col("term") != "") & F.contains(low, F.lower("term"))).select("__h", "t").distinct()
    joined = headers.join(hits, headers[header_col] == hits["__h"])
    return joined.select(*[headers[c] for c in headers.columns], "t", F.element_at(_target_names(synonyms), F.col("t") + 1).alias("target"))


def synonym_hits(headers: DataFrame, synonyms: dict, header_col: str = "header") -> DataFrame:
    """Per header, every target it could take: ``(…, t, target, sub, close)`` rows.

    Terms meet each distinct header text once (corpora repeat the same headers across many files). Containment is a
    JVM expression; only pairs that may be close enough get their ratio computed.
    """
    pairs = _texts_with_terms(headers, header_col, synonyms).withColumn("low", trim_ws(F.lower(F.col("__h"))))
    sub = (F.col("term") != "") & F.contains(F.col("low"), F.lower("term"))
    pairs = pairs.withColumn("sub", sub).withColumn("may", _may_reach(F.col("term"), F.col("low"), CLOSE_CUTOFF))
    plain = pairs.where("sub").select("__h", "t", F.lit(True).alias("sub"), F.lit(False).alias("close"))
    close = pairs.where("may").select("__h", "t", F.lit(False).alias("sub"), (_ratio("term", "low") >= CLOSE_CUTOFF).alias("close")).where("close")
    hits = plain.unionByName(close).groupBy("__h", "t").agg(F.max("sub").alias("sub"), F.max("close").alias("close"))
    joined = headers.join(hits, headers[header_col] == hits["__h"])
    return joined.select(*[headers[c] for c in headers.columns], "t", F.element_at(_target_names(synonyms), F.col("t") + 1).alias("target"), "sub", "close")


def assign_once(hits_in_order, n_targets: int) -> list:
    """Give each header of a file at most one target and each target at most one header.

    ``hits_in_order``: ``[(key, {t: (sub, close)}), …]`` in header order. A header takes its first hit among the free
    targets; when that is only close, the next free target takes precedence if it is contained in the header.
    """
    free, out = list(range(n_targets)), []
    for key, hits in hits_in_order:
        wanted = [k for k, t in enumerate(free) if t in hits and any(hits[t])]
        if not wanted:
            continue
        k = wanted[0]
        following = hits.get(free[k + 1], (False,))[0] if k + 1 < len(free) else False
        out.append((key, free.pop(k + 1 if following and not hits[free[k]][0] else k)))
    return out


def auto_map(headers: DataFrame, synonyms: dict) -> DataFrame:
    """M2: map each header of each file to a target field, each target at most once per file.

    Headers are taken in order (see ``assign_once``); a header without a target gets its snake_case form.

    Scale: a header that matches target t while t is free always takes some target, so the header
    that finally takes t is among the first |T| headers hitting t. Candidates are cut to those
    (an exact bound, ``row_number <= |T|`` which Spark limits per partition before the shuffle),
    and the ordered walk runs per file on at most |T|² rows.
    """
    n = len(synonyms)
    scope = file_keys(headers)
    w = Window.partitionBy(*scope, "t").orderBy("ordinal")
    cand = (synonym_hits(headers, synonyms).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
            .select(*scope, F.col("ordinal").cast("long").alias("ordinal"), "t", "sub", "close"))
    schema = StructType([*(cand.schema[c] for c in scope), StructField("ordinal", LongType()), StructField("t", IntegerType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = {}
        for r in pdf.sort_values(["ordinal", "t"]).itertuples():
            ordered.setdefault(int(r.ordinal), {})[int(r.t)] = (bool(r.sub), bool(r.close))
        picks = pd.DataFrame(assign_once(ordered.items(), n), columns=["ordinal", "t"])
        return picks.assign(**{c: pdf[c].iloc[0] for c in scope})[[*scope, "ordinal", "t"]]

    picks = cand.groupBy(*scope).applyInPandas(walk, schema)
    out = headers.join(picks, [*scope, "ordinal"], "left")
    return out.select(
        *scope, "ordinal", "header",
        F.when(F.col("t").isNotNull(), F.element_at(_target_names(synonyms), F.col("t") + 1))
         .otherwise(snake_case(F.col("header"))).alias("target"),
        F.when(F.col("t").isNotNull(), F.lit("synonym")).otherwise(F.lit("snake_case")).alias("how"))


def first_substring_target(headers: DataFrame, synonyms: dict) -> DataFrame:
    """Per header the first target (config order) with a term contained in it, without the
    once-only rule; headers without a hit are left out."""
    return (substring_hits(headers, synonyms).groupBy(*headers.columns).agg(F.min("t").alias("t"))
            .withColumn("target", F.element_at(_target_names(synonyms), F.col("t") + 1)).drop("t"))


# ---------------------------------------------------------------------------------------------
# M3


def best_target(headers: DataFrame, synonyms: dict, header_col: str = "header") -> DataFrame:
    """M3: best target by similarity ratio (>= 0.6) of normalised texts; of equal ones the first in the configuration.

    Every distinct header text meets every term once; pairs that cannot reach the cutoff are left out before
    the ratio, and an aggregation takes the best."""
    pairs = _texts_with_terms(headers, header_col, synonyms, header_norm).withColumn("norm", header_norm(F.col("__h")))
    near = pairs.where(_may_reach(F.col("norm"), F.col("term"), BEST_CUTOFF)).withColumn("ratio", _ratio("norm", "term"))
    best = near.where(F.col("ratio") >= BEST_CUTOFF).groupBy("__h").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "k", "t")).alias("b"))
    scored = best.select("__h", F.element_at(_target_names(synonyms), F.col("b.t") + 1).alias("target"))
    out = headers.join(scored, headers[header_col] == scored["__h"], "left")
    return out.select(*[headers[c] for c in headers.columns], "target")


# ---------------------------------------------------------------------------------------------
# M4 M5


def header_candidates(profile: DataFrame, blocks: DataFrame, data_type: str = "generic",
                      target_fields=None) -> DataFrame:
    """M4 + M5: ranked header lists per file from the column profile and the numeric blocks.

    ``profile``: ``(source_file, ordinal, column, is_numeric, is_texty)``; ``blocks`` from
    ``numeric_blocks``. Arrays are bounded by the width of a file.
    """
    cols = profile.groupBy(FILE).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column", "is_numeric", "is_texty"))).alias("c"))
    cols = cols.select(
        FILE,
        F.transform("c", lambda x: x["column"]).alias("headers"),
        F.transform(F.filter("c", lambda x: x["is_numeric"]), lambda x: x["column"]).alias("numeric"),
        F.transform(F.filter("c", lambda x: x["is_texty"]), lambda x: x["column"]).alias("texty"))
    detected = cols.select(FILE, F.lit("As detected").alias("label"), "headers",
                           F.lit(0.20).alias("score"), F.lit("Headers as read from file.").alias("note"))
    ym = cols.select(FILE, F.transform("headers", lambda h: year_month_label(h)).alias("h2"), "headers")
    combined = ym.where(F.col("h2") != F.col("headers")).select(
        FILE, F.lit("Combined year+month headers").alias("label"), F.col("h2").alias("headers"),
        F.lit(0.35).alias("score"),
        F.lit("Merged year + month tokens into single period labels.").alias("note"))
    b = blocks.join(cols.select(FILE, "headers", "texty"), FILE)
    left = F.when(F.col("start_idx") > 0, F.element_at("headers", F.col("start_idx")))
    has_key = left.isNotNull() & F.array_contains("texty", left) & ~F.array_contains("columns", left)
    n = F.size("columns")
    base_note = F.format_string("Numeric block cols %d-%d (size %d)", F.col("start_idx"),
                                F.col("start_idx") + n - 1, n)
    block = b.select(
        FILE, F.lit("Numeric block ordering").alias("label"),
        F.when(has_key, F.concat(F.array(left), F.col("columns"))).otherwise(F.col("columns")).alias("headers"),
        F.least(F.when(has_key, 0.6 + 0.05 * n).otherwise(0.5 + 0.05 * n), F.lit(0.9)).alias("score"),
        F.when(has_key, F.concat(base_note, F.lit("; key column '"), left, F.lit("' on the left.")))
         .otherwise(base_note).alias("note"))
    parts = [detected, combined, block]
    key = F.element_at("texty", 1)
    if data_type == "product_sales":
        parts.append(cols.where((F.size("texty") > 0) & (F.size("numeric") > 0)).select(
            FILE, F.lit("Product key + numeric measures").alias("label"),
            F.concat(F.array(key), F.col("numeric")).alias("headers"),
            (0.55 + 0.05 * F.size("numeric")).alias("score"),
            F.concat(F.lit("Text key '"), key, F.lit("' with numeric measures.")).alias("note")))
    if data_type == "product_descriptions":
        parts.append(cols.where(F.size("texty") > 0).select(
            FILE, F.lit("Description-first ordering").alias("label"),
            F.concat(F.array(key), F.filter("headers", lambda h: h != key)).alias("headers"),
            F.lit(0.45).alias("score"),
            F.concat(F.lit("Longest text column '"), key, F.lit("' first.")).alias("note")))
    if data_type == "sales":
        parts.append(cols.where(F.size("numeric") > 0).select(
            FILE, F.lit("Numeric-first (sales) ordering").alias("label"),
            F.concat("numeric", F.array_except("headers", "numeric")).alias("headers"),
            (0.5 + 0.05 * F.size("numeric")).alias("score"),
            F.lit("Prioritized numeric columns (likely amounts/quantities).").alias("note")))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    cand = cand.where((F.col("label") == "As detected") | (F.col("score") >= 0.25))
    target = F.array(*[F.lit(t) for t in (target_fields or [])]) if target_fields else \
        F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(target, F.col("headers")))
    extra = F.array_sort(F.array_distinct(F.array_except(F.col("headers"), target)))
    cand = cand.withColumn("missing", missing).withColumn("extra", extra)

    def listing(arr, title):
        more = F.when(F.size(arr) > 5, F.lit("...")).otherwise(F.lit(""))
        return F.when(F.size(arr) > 0, F.concat(F.lit(title), F.array_join(F.slice(arr, 1, 5), ", "), more)) \
                .otherwise(F.lit(""))

    miss_txt = listing(F.col("missing"), " missing vs current schema: ")
    extra_txt = listing(F.col("extra"), " extra: ")
    note = F.when((F.size("missing") > 0) | (F.size("extra") > 0),
                  F.trim(F.concat(F.col("note"), F.lit(" |"), miss_txt, F.lit(" "), extra_txt)))
    return cand.withColumn("note", F.coalesce(note, F.col("note")))
