"""Queries for header discovery and mapping (M1-M7, V8) over corpora derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregate import column_profile
from ..operators.discover import (auto_map, best_target, first_substring_target, header_candidates,
                                  header_row_guess)
from ..operators.lineage import FILE
from ..operators.order import numeric_blocks
from ..operators.synonyms import (DEFAULT_SYNONYMS, LEARNED_SYNONYMS, known_synonyms, learn_synonyms,
                                  merge_synonyms, synonym_frame)
from ..operators.validate import mapping_coverage
from .catalog import register, table

# ---------------------------------------------------------------------------------------------
# M1: customer as sheets (one per market segment) with banner rows above the header


def _customer_cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")

    def cell(col, value, kind):
        return F.struct(F.lit(col).alias("col"), value.alias("value"), kind.alias("kind"))

    neg = F.col("c_acctbal") < 0
    text, number = F.lit("text"), F.lit("number")
    data = c.select(
        seg.alias(FILE), (F.col("c_custkey") + 10).alias("row"),
        F.explode(F.array(
            cell(0, F.when(neg, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")),
                 F.when(neg, text).otherwise(number)),
            cell(1, F.col("c_name"), text),
            cell(2, F.when(neg, F.lit("negative")).otherwise(F.col("c_acctbal").cast("string")),
                 F.when(neg, text).otherwise(number)),
            cell(3, F.when(F.col("c_nationkey") == 0, seg), text))).alias("c"))
    data = data.select(FILE, "row", "c.col", "c.value", "c.kind")
    files = c.select(seg.alias(FILE)).distinct()
    build = F.col(FILE) == "BUILDING"
    banner = files.select(FILE, F.explode(F.array(
        F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("Customer report").alias("value")),
        F.struct(F.lit(2).alias("row"), F.lit(0).alias("col"), F.lit("Segment").alias("value")),
        F.struct(F.lit(2).alias("row"), F.lit(1).alias("col"), F.col(FILE).alias("value")),
        F.struct(F.lit(3).alias("row"), F.lit(0).alias("col"), F.lit("custkey").alias("value")),
        F.struct(F.lit(3).alias("row"), F.lit(1).alias("col"), F.lit("name").alias("value")),
        F.struct(F.lit(3).alias("row"), F.lit(2).alias("col"),
                 F.when(~build, F.lit("acctbal")).alias("value")),
        F.struct(F.lit(3).alias("row"), F.lit(3).alias("col"),
                 F.when(~build, F.lit("note")).alias("value")))).alias("b"))
    banner = banner.select(FILE, "b.row", "b.col", "b.value", F.lit("text").alias("kind"))
    return data.unionByName(banner)


@register("header_row_guess", """
WITH data AS (
  SELECT c_mktsegment AS f, c_custkey + 10 AS "row", 0 AS col,
         CASE WHEN c_acctbal < 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS value,
         CASE WHEN c_acctbal < 0 THEN 'text' ELSE 'number' END AS kind FROM customer
  UNION ALL SELECT c_mktsegment, c_custkey + 10, 1, c_name, 'text' FROM customer
  UNION ALL SELECT c_mktsegment, c_custkey + 10, 2,
         CASE WHEN c_acctbal < 0 THEN 'negative' ELSE CAST(c_acctbal AS VARCHAR) END,
         CASE WHEN c_acctbal < 0 THEN 'text' ELSE 'number' END FROM customer
  UNION ALL SELECT c_mktsegment, c_custkey + 10, 3, CASE WHEN c_nationkey = 0 THEN c_mktsegment END, 'text'
  FROM customer),
files AS (SELECT DISTINCT c_mktsegment AS f FROM customer),
banner AS (
  SELECT f, 0 AS "row", 0 AS col, 'Customer report' AS value, 'text' AS kind FROM files
  UNION ALL SELECT f, 2, 0, 'Segment', 'text' FROM files
  UNION ALL SELECT f, 2, 1, f, 'text' FROM files
  UNION ALL SELECT f, 3, 0, 'custkey', 'text' FROM files
  UNION ALL SELECT f, 3, 1, 'name', 'text' FROM files
  UNION ALL SELECT f, 3, 2, CASE WHEN f <> 'BUILDING' THEN 'acctbal' END, 'text' FROM files
  UNION ALL SELECT f, 3, 3, CASE WHEN f <> 'BUILDING' THEN 'note' END, 'text' FROM files),
cells AS (SELECT * FROM data UNION ALL SELECT * FROM banner),
width AS (SELECT f, max(col) + 1 AS width FROM cells GROUP BY f),
per_row AS (SELECT f, "row", count(*) AS filled, sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END) AS texts
            FROM cells WHERE value IS NOT NULL GROUP BY f, "row"),
q AS (SELECT p.f, min(p."row") AS header_row FROM per_row p JOIN width w USING (f)
      WHERE p.texts / p.filled > 0.8 AND p.filled / w.width > 0.5 GROUP BY p.f)
SELECT w.f AS source_file, coalesce(q.header_row, 0) AS header_row FROM width w LEFT JOIN q USING (f)
""")
def q_header_row_guess(spark, sf_dir):
    return header_row_guess(_customer_cells(spark, sf_dir))


# ---------------------------------------------------------------------------------------------
# M2 M3 M6 M7 V8: header corpus, one "file" per part brand, headers in part-key order

# Header phrases that sheets in the wild carry, picked per part by its size.
HEADER_PHRASES = ["Product Code", "Qty", "Amount", "Invoice Date", "Vendor", "Unit Price", "Sales Region",
                  "Order No", "Net Sales", "Item", "Description", "Total", "Units Sold", "Posting Date",
                  "Comment", "Warehouse", "Doc Date"]


def _header_corpus(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    phrases = F.array(*[F.lit(x) for x in HEADER_PHRASES])
    phrase = F.element_at(phrases, (F.col("p_size") % len(HEADER_PHRASES)) + 1)
    return p.select(F.col("p_brand").alias(FILE), F.col("p_partkey").cast("int").alias("ordinal"),
                    F.concat(phrase, F.lit(" "), F.col("p_name")).alias("header"))


def _header_corpus_sql() -> str:
    lst = ", ".join("'" + x + "'" for x in HEADER_PHRASES)
    return (f"SELECT p_brand AS source_file, CAST(p_partkey AS INTEGER) AS ordinal, "
            f"[{lst}][p_size % {len(HEADER_PHRASES)} + 1] || ' ' || p_name AS header FROM part")


def _synonym_values_sql(synonyms: dict) -> str:
    rows = []
    for i, (t, terms) in enumerate(synonyms.items()):
        for term in [t] + list(terms):
            rows.append(f"({i}, '{t}', '{term}')")
    return "(VALUES " + ", ".join(rows) + ") AS s(t, target, term)"


_HITS_SQL = f"""
WITH h AS ({_header_corpus_sql()}),
hits AS (
  SELECT h.source_file, h.ordinal, h.header, min(s.t) AS t
  FROM h JOIN {_synonym_values_sql(DEFAULT_SYNONYMS)} ON contains(lower(trim(h.header)), lower(s.term))
  GROUP BY h.source_file, h.ordinal, h.header),
named AS (
  SELECT hits.source_file, hits.ordinal, hits.header, n.target
  FROM hits JOIN (SELECT DISTINCT t, target FROM {_synonym_values_sql(DEFAULT_SYNONYMS)}) n USING (t))
"""


@register("synonym_hits", _HITS_SQL + "SELECT source_file, ordinal, header, target FROM named")
def q_synonym_hits(spark, sf_dir):
    return first_substring_target(_header_corpus(spark, sf_dir), DEFAULT_SYNONYMS)


@register("auto_map")
def q_auto_map(spark, sf_dir):
    return auto_map(_header_corpus(spark, sf_dir), DEFAULT_SYNONYMS)


@register("best_target")
def q_best_target(spark, sf_dir):
    return best_target(_header_corpus(spark, sf_dir), DEFAULT_SYNONYMS)


def _known_sql() -> str:
    rows = [f"('{t}', '{term}')" for syn in (DEFAULT_SYNONYMS, LEARNED_SYNONYMS)
            for t, terms in syn.items() for term in terms]
    return "(VALUES " + ", ".join(rows) + ") AS k(target, term)"


_LEARN_SQL = _HITS_SQL + f"""
, new_terms AS (
  SELECT target, lower(trim(header)) AS low, min_by(trim(header), (ordinal, trim(header))) AS term
  FROM named
  WHERE NOT EXISTS (SELECT 1 FROM {_known_sql()} WHERE k.target = named.target
                    AND lower(k.term) = lower(trim(named.header)))
  GROUP BY target, lower(trim(header)))
"""


@register("learn_synonyms", _LEARN_SQL + "SELECT target, term FROM new_terms")
def q_learn_synonyms(spark, sf_dir):
    known = known_synonyms(spark)
    mapping = first_substring_target(_header_corpus(spark, sf_dir), DEFAULT_SYNONYMS)
    return learn_synonyms(mapping, known, order_col="ordinal")


def _merged_sql() -> str:
    rows = []
    for origin, rank, syn in (("base", 0, DEFAULT_SYNONYMS), ("user", 1, LEARNED_SYNONYMS)):
        for t, terms in syn.items():
            for j, term in enumerate(terms):
                rows.append(f"('{t}', '{term}', '{origin}', {rank}, {j})")
    return "(VALUES " + ", ".join(rows) + ") AS c(target, term, origin, rnk, pos)"


@register("merge_synonyms", _LEARN_SQL + f"""
, allrows AS (
  SELECT target, term, origin, rnk, pos FROM {_merged_sql()}
  UNION ALL
  SELECT target, term, 'learned' AS origin, 2 AS rnk, 0 AS pos FROM new_terms)
SELECT target, min_by(term, (rnk, pos, term)) AS term, min_by(origin, (rnk, pos, term)) AS origin
FROM allrows GROUP BY target, lower(term)
""")
def q_merge_synonyms(spark, sf_dir):
    base = known_synonyms(spark)
    mapping = first_substring_target(_header_corpus(spark, sf_dir), DEFAULT_SYNONYMS)
    learned = learn_synonyms(mapping, base, order_col="ordinal")
    learned = learned.select("target", "term", F.lit("learned").alias("origin"), F.lit(0).alias("target_pos"),
                             F.lit(0).alias("term_pos"))
    return merge_synonyms(base, learned).select("target", "term", "origin")


@register("mapping_coverage", _HITS_SQL + f"""
, files AS (SELECT DISTINCT source_file FROM h),
targets AS (SELECT DISTINCT target FROM {_synonym_values_sql(DEFAULT_SYNONYMS)})
SELECT f.source_file, t.target FROM files f, targets t
WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.source_file = f.source_file AND n.target = t.target)
""")
def q_mapping_coverage(spark, sf_dir):
    mapping = first_substring_target(_header_corpus(spark, sf_dir), DEFAULT_SYNONYMS)
    files = mapping.select(FILE).union(_header_corpus(spark, sf_dir).select(FILE)).distinct()
    # per file: every configured target is expected (a generator over the fixed target list)
    expected = files.withColumn("target", F.explode(F.array(*[F.lit(t) for t in DEFAULT_SYNONYMS])))
    return expected.join(mapping.select(FILE, "target").distinct(), [FILE, "target"], "left_anti")


# ---------------------------------------------------------------------------------------------
# M4 M5: candidates from per-file profiles of lineitem (one "file" per return flag)


def _sheet_like(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("lineitem_"), "l_returnflag").alias(FILE),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" of order "),
                 F.col("l_orderkey").cast("string")).alias("Item description"),
        F.col("l_quantity").alias("2020 Jan"), F.col("l_extendedprice").alias("2020/helmikuu"),
        F.col("l_discount").alias("Discount"), F.year("l_shipdate").alias("Ship year"),
        F.col("l_linestatus").alias("Status"), F.col("l_tax").alias("Tax"))


SHEET_COLUMNS = [
    ("Item description", "'part ' || CAST(l_partkey AS VARCHAR) || ' of order ' || CAST(l_orderkey AS VARCHAR)"),
    ("2020 Jan", "l_quantity"),
    ("2020/helmikuu", "l_extendedprice"),
    ("Discount", "l_discount"),
    ("Ship year", "year(l_shipdate)"),
    ("Status", "l_linestatus"),
    ("Tax", "l_tax"),
]
CANDIDATE_TARGETS = ["Item description", "2020-jan", "sales_amount"]


def _ym_lambda() -> str:
    """DuckDB lambda with the year+month label rule (parts on / - blanks; 4-digit year; month)."""
    from .q_transform import _month_sql
    parts = "list_filter(string_split_regex(replace(replace(h, '/', ' '), '-', ' '), '\\s+'), lambda p: p <> '')"
    year = f"list_filter({parts}, lambda p: regexp_matches(p, '^[0-9]{{4}}$'))[1]"
    month = f"list_filter(list_transform({parts}, lambda p: {_month_sql('p')}), lambda m: m IS NOT NULL)[1]"
    return f"lambda h: CASE WHEN {year} IS NOT NULL AND {month} IS NOT NULL THEN {year} || '-' || {month} ELSE h END"


def _candidates_sql() -> str:
    num_re = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
    raw = []
    for i, (name, expr) in enumerate(SHEET_COLUMNS):
        txt = f"CAST(({expr}) AS VARCHAR)"
        num = f"CASE WHEN regexp_matches({txt}, '{num_re}') THEN try_cast(trim({txt}) AS DOUBLE) END"
        raw.append(
            f"SELECT 'lineitem_' || l_returnflag AS source_file, {i} AS ordinal, '{name}' AS col, "
            f"avg(CASE WHEN {num} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS r, count({num}) AS n, "
            f"sum(CASE WHEN {num} BETWEEN 1900 AND 2100 THEN 1 ELSE 0 END) AS y, "
            f"avg(length(coalesce({txt}, ''))) AS l FROM lineitem GROUP BY l_returnflag")
    targets = "[" + ", ".join(f"'{t}'" for t in CANDIDATE_TARGETS) + "]"
    q = "'"

    def d(x):
        return f"CAST({x} AS DOUBLE)"

    return f"""
WITH raw AS ({" UNION ALL ".join(raw)}),
prof AS (
  SELECT source_file, ordinal, col,
         r > 0.6 AND NOT coalesce(n > 0 AND y / n > 0.6, false) AS is_numeric,
         l > 12 AND r < 0.3 AS is_texty
  FROM raw),
hdr AS (
  SELECT source_file, list(col ORDER BY ordinal) AS headers,
         coalesce(list(col ORDER BY ordinal) FILTER (WHERE is_numeric), []) AS numeric,
         coalesce(list(col ORDER BY ordinal) FILTER (WHERE is_texty), []) AS texty
  FROM prof GROUP BY source_file),
isl AS (SELECT source_file, ordinal, col,
               ordinal - row_number() OVER (PARTITION BY source_file ORDER BY ordinal) AS island
        FROM prof WHERE is_numeric),
blocks AS (SELECT source_file, list(col ORDER BY ordinal) AS cols, min(ordinal) AS start_idx
           FROM isl GROUP BY source_file, island),
bk AS (SELECT b.source_file, b.cols, b.start_idx,
              CASE WHEN b.start_idx > 0 THEN h.headers[b.start_idx] END AS lft, h.texty
       FROM blocks b JOIN hdr h USING (source_file)),
bk2 AS (SELECT *, coalesce(lft IS NOT NULL AND list_contains(texty, lft) AND NOT list_contains(cols, lft), false)
                  AS has_key FROM bk),
cand AS (
  SELECT source_file, 'As detected' AS label, headers, {d("0.20")} AS score, 'Headers as read from file.' AS note
  FROM hdr
  UNION ALL
  SELECT source_file, 'Combined year+month headers', h2, {d("0.35")},
         'Merged year + month tokens into single period labels.'
  FROM (SELECT source_file, headers, list_transform(headers, {_ym_lambda()}) AS h2 FROM hdr) WHERE h2 <> headers
  UNION ALL
  SELECT source_file, 'Numeric block ordering',
         CASE WHEN has_key THEN list_prepend(lft, cols) ELSE cols END,
         least(CASE WHEN has_key THEN {d("0.6")} + {d("0.05")} * len(cols) ELSE {d("0.5")} + {d("0.05")} * len(cols) END,
               {d("0.9")}),
         'Numeric block cols ' || CAST(start_idx AS VARCHAR) || '-' || CAST(start_idx + len(cols) - 1 AS VARCHAR)
           || ' (size ' || CAST(len(cols) AS VARCHAR) || ')'
           || CASE WHEN has_key THEN '; key column {q}{q}' || lft || '{q}{q} on the left.' ELSE '' END
  FROM bk2
  UNION ALL
  SELECT source_file, 'Numeric-first (sales) ordering',
         list_concat(numeric, list_filter(headers, lambda h: NOT list_contains(numeric, h))),
         {d("0.5")} + {d("0.05")} * len(numeric), 'Prioritized numeric columns (likely amounts/quantities).'
  FROM hdr WHERE len(numeric) > 0),
ann AS (
  SELECT *, list_sort(list_filter({targets}, lambda t: NOT list_contains(headers, t))) AS missing,
            list_sort(list_distinct(list_filter(headers, lambda h: NOT list_contains({targets}, h)))) AS extra
  FROM cand WHERE label = 'As detected' OR score >= 0.25)
SELECT source_file, label, array_to_string(headers, '|') AS headers, round(score, 4) AS score,
       CASE WHEN len(missing) > 0 OR len(extra) > 0 THEN trim(note || ' |'
            || CASE WHEN len(missing) > 0 THEN ' missing vs current schema: ' || array_to_string(missing[1:5], ', ')
                    || CASE WHEN len(missing) > 5 THEN '...' ELSE '' END ELSE '' END
            || ' '
            || CASE WHEN len(extra) > 0 THEN ' extra: ' || array_to_string(extra[1:5], ', ')
                    || CASE WHEN len(extra) > 5 THEN '...' ELSE '' END ELSE '' END)
            ELSE note END AS note
FROM ann
"""


@register("header_candidates", _candidates_sql())
def q_header_candidates(spark, sf_dir):
    from ..session import checkpointed
    # the profile (one row per file and column) feeds several candidate branches: materialise it
    # once in the shared checkpoint folder instead of re-scanning the data per branch
    prof = checkpointed(column_profile(_sheet_like(spark, sf_dir)))
    blocks = numeric_blocks(prof)
    cand = header_candidates(prof, blocks, "sales", CANDIDATE_TARGETS)
    return cand.select(FILE, "label", F.array_join("headers", "|").alias("headers"),
                       F.round("score", 4).alias("score"), "note")
