"""Queries for drift, contract validation and verdicts (V1-V7) and the profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregate import column_profile, file_sizes, frame_profile, value_counts_top
from ..operators.lineage import FILE, KEY, ORD
from ..operators.order import numeric_blocks
from ..operators.validate import drift_by_file, drift_gate, validate, verdict, verdict_one_pass
from ..spec import JobSpec
from .catalog import register, table

# ---------------------------------------------------------------------------------------------
# V1 V2: per-file drift of a stacked frame

DRIFT_EXPECTED = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_comment"]


def _orders_as_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    prio = F.col("o_orderpriority")
    return o.select(
        prio.alias(FILE), "o_orderkey",
        F.when(prio != "1-URGENT", F.col("o_custkey")).alias("o_custkey"),
        F.when(prio != "2-HIGH", F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(prio == "5-LOW", F.col("o_orderstatus")).alias("o_note"),
        F.lit("orders").alias("provider_id"))


_DRIFT_SRC = """
WITH s AS (
  SELECT o_orderpriority AS source_file, o_orderkey,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS o_custkey,
         CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END AS o_note,
         'orders' AS provider_id
  FROM orders),
p AS (
  SELECT source_file, list_filter([
           CASE WHEN count(o_orderkey) > 0 THEN 'o_orderkey' END,
           CASE WHEN count(o_custkey) > 0 THEN 'o_custkey' END,
           CASE WHEN count(o_totalprice) > 0 THEN 'o_totalprice' END,
           CASE WHEN count(o_orderdate) > 0 THEN 'o_orderdate' END,
           CASE WHEN count(o_note) > 0 THEN 'o_note' END,
           CASE WHEN count(provider_id) > 0 THEN 'provider_id' END], lambda x: x IS NOT NULL) AS present
  FROM s GROUP BY source_file),
d AS (
  SELECT source_file,
         list_sort(list_filter(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate', 'o_comment'],
                               lambda x: NOT list_contains(present, x))) AS missing,
         list_sort(list_filter(present, lambda x: NOT list_contains(['o_orderkey', 'o_custkey', 'o_totalprice',
                               'o_orderdate', 'o_comment'], x))) AS extra
  FROM p)
"""


@register("schema_drift", _DRIFT_SRC + """
SELECT source_file, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM d
""")
def q_schema_drift(spark, sf_dir):
    d = drift_by_file(_orders_as_files(spark, sf_dir), DRIFT_EXPECTED)
    return d.select(FILE, F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@register("drift_gate", _DRIFT_SRC + """
SELECT source_file, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra,
       len(missing) > 0 OR len(list_filter(extra, lambda x: x NOT IN ('provider_id', 'source_sheet', 'source_file'))) > 0
         AS drift_failed
FROM d
""")
def q_drift_gate(spark, sf_dir):
    d = drift_gate(drift_by_file(_orders_as_files(spark, sf_dir), DRIFT_EXPECTED), True, True)
    return d.select(FILE, F.array_join("missing", ",").alias("missing"),
                    F.array_join("extra", ",").alias("extra"), "drift_failed")


@register("missing_keys", _DRIFT_SRC + """
, keys AS (
  SELECT source_file, list_filter(['o_orderkey', 'o_custkey', 'o_totalprice'],
                                  lambda k: NOT list_contains(present, k)) AS missing FROM p)
SELECT source_file, array_to_string(missing, ',') AS missing,
       source_file || ': missing ' || array_to_string(missing[1:5], ', ') AS message
FROM keys WHERE len(missing) > 0
""")
def q_missing_keys(spark, sf_dir):
    """Merge keys each file of a stacked frame lacks, before any merge runs."""
    from ..operators.combine import missing_keys_by_file
    return missing_keys_by_file(_orders_as_files(spark, sf_dir), ["o_orderkey", "o_custkey", "o_totalprice"])


# ---------------------------------------------------------------------------------------------
# V3 V4 V7: coerce / contract validation of lineitem as a contract-shaped sheet

def _lineitem_contract(spark, sf_dir, per_flag_file: bool = False):
    li = table(spark, sf_dir, "lineitem")
    file_col = (F.concat(F.lit("lineitem_"), F.col("l_returnflag")) if per_flag_file
                else F.lit("lineitem.parquet"))
    return li.select(
        F.col("l_suppkey").alias("provider_id"),
        F.col("l_partkey").alias("article_sku"),
        F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("report_date"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.col("l_quantity").cast("string"), F.lit(" pcs")))
         .otherwise(F.col("l_extendedprice").cast("string")).alias("sales_amount"),
        F.when(F.col("l_tax") == 0.08, (F.col("l_quantity") + 0.25).cast("string"))
         .otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        file_col.alias(FILE),
        F.struct("l_orderkey", "l_linenumber").alias(ORD))


_ROW = "CAST(json_object('l_orderkey', l_orderkey, 'l_linenumber', l_linenumber) AS VARCHAR)"


@register("validate_coerce", f"""
SELECT 'lineitem.parquet' AS source_file, 'report_date' AS "column", 'coerce to timestamp' AS "check",
       'n/a' AS failure_case, {_ROW} AS "row" FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT 'lineitem.parquet', 'sales_amount', 'coerce to double', CAST(l_quantity AS VARCHAR) || ' pcs', {_ROW}
FROM lineitem WHERE l_linestatus = 'O'
""")
def q_validate_coerce(spark, sf_dir):
    _, errors = validate(_lineitem_contract(spark, sf_dir), JobSpec(), "coerce")
    return errors


@register("validate_contract", f"""
SELECT 'lineitem.parquet' AS source_file, 'quantity' AS "column", 'coerce to int' AS "check",
       CAST(l_quantity + 0.25 AS VARCHAR) AS failure_case, {_ROW} AS "row" FROM lineitem WHERE l_tax = 0.08
UNION ALL
SELECT 'lineitem.parquet', 'report_date', 'coerce to timestamp', 'n/a', {_ROW} FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT 'lineitem.parquet', 'sales_amount', 'coerce to double', CAST(l_quantity AS VARCHAR) || ' pcs', {_ROW}
FROM lineitem WHERE l_linestatus = 'O'
""")
def q_validate_contract(spark, sf_dir):
    spec = JobSpec(required_fields=("article_sku",), field_types={"quantity": "int", "nope": "int"})
    _, errors = validate(_lineitem_contract(spark, sf_dir), spec, "contract")
    return errors


@register("typed_contract_frame", """
SELECT CAST(l_suppkey AS VARCHAR) AS provider_id, CAST(l_partkey AS VARCHAR) AS article_sku,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS report_date,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_extendedprice END AS sales_amount,
       CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity
FROM lineitem
""")
def q_typed_contract_frame(spark, sf_dir):
    spec = JobSpec(required_fields=("article_sku",), field_types={"quantity": "int"})
    typed, _ = validate(_lineitem_contract(spark, sf_dir), spec, "contract")
    return typed.drop(FILE, ORD, KEY)


@register("verdict", """
SELECT 'lineitem_' || l_returnflag AS source_file,
       count(*) FILTER (WHERE l_returnflag = 'R' OR l_linestatus = 'O') = 0 AS is_valid,
       count(*) FILTER (WHERE l_returnflag = 'R') + count(*) FILTER (WHERE l_linestatus = 'O') AS errors,
       count(*) AS row_count
FROM lineitem GROUP BY l_returnflag
""")
def q_verdict(spark, sf_dir):
    return verdict_one_pass(_lineitem_contract(spark, sf_dir, per_flag_file=True), JobSpec(), "coerce")


@register("verdict_contract", """
SELECT 'lineitem_' || l_returnflag AS source_file,
       count(*) FILTER (WHERE l_returnflag = 'R') + count(*) FILTER (WHERE l_linestatus = 'O')
         + count(*) FILTER (WHERE l_tax = 0.08) = 0 AS is_valid,
       count(*) FILTER (WHERE l_returnflag = 'R') + count(*) FILTER (WHERE l_linestatus = 'O')
         + count(*) FILTER (WHERE l_tax = 0.08) AS errors,
       count(*) AS row_count
FROM lineitem GROUP BY l_returnflag
""")
def q_verdict_contract(spark, sf_dir):
    """V4 + V7: declared types, then the contract, counted per file in one pass; the same
    numbers as the error table of ``validate_contract`` grouped by file."""
    spec = JobSpec(required_fields=("article_sku",), field_types={"quantity": "int"})
    return verdict_one_pass(_lineitem_contract(spark, sf_dir, per_flag_file=True), spec, "contract")


# ---------------------------------------------------------------------------------------------
# A3 A4 D3 A9


@register("frame_profile", """
SELECT count(*) AS "rows", 6 AS columns,
       sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT
           + (value IS NULL)::INT + (props IS NULL)::INT) AS null_cells
FROM (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
             CASE WHEN event_type <> 'view' THEN value END AS value, props FROM events)
""")
def q_frame_profile(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ev = ev.withColumns({"event_type": F.when(F.col("event_type") != "error", F.col("event_type")),
                         "value": F.when(F.col("event_type") != "view", F.col("value"))})
    return frame_profile(ev)


@register("value_counts_top25", """
SELECT p_name, count(*) AS count FROM part WHERE p_name IS NOT NULL GROUP BY p_name
ORDER BY count DESC, p_name LIMIT 25
""")
def q_value_counts_top25(spark, sf_dir):
    return value_counts_top(table(spark, sf_dir, "part"), "p_name", 25)


@register("file_sizes", """
SELECT 'lineitem_' || l_returnflag AS source_file, count(*) AS "rows", 4 AS columns FROM lineitem GROUP BY l_returnflag
""")
def q_file_sizes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = li.select(F.concat(F.lit("lineitem_"), "l_returnflag").alias(FILE), "l_orderkey", "l_partkey",
                   "l_quantity", "l_shipdate")
    return file_sizes(df)


# ---------------------------------------------------------------------------------------------
# A5-A8 D4 over a sheet-like projection of lineitem

PROFILE_COLUMNS = [
    ("l_orderkey", "l_orderkey"),
    ("l_returnflag", "l_returnflag"),
    ("l_quantity", "l_quantity"),
    ("l_extendedprice", "l_extendedprice"),
    ("l_linestatus", "l_linestatus"),
    ("l_discount", "l_discount"),
    ("l_tax", "l_tax"),
    ("ship_year", "year(l_shipdate)"),
    ("qty_text", "CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END"),
    ("remark", "CASE WHEN l_linestatus = 'O' THEN 'open line, to be shipped' END"),
    ("l_suppkey", "l_suppkey"),
]


def _profile_source(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus", "l_discount",
        "l_tax", F.year("l_shipdate").alias("ship_year"),
        F.when(F.col("l_returnflag") == "N", F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
         .alias("qty_text"),
        F.when(F.col("l_linestatus") == "O", F.lit("open line, to be shipped")).alias("remark"),
        "l_suppkey")


def _profile_sql() -> str:
    num_re = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    parts = []
    for i, (name, expr) in enumerate(PROFILE_COLUMNS):
        txt = f"CAST(({expr}) AS VARCHAR)"
        num = f"CASE WHEN regexp_matches({txt}, '{num_re}') THEN try_cast(trim({txt}) AS DOUBLE) END"
        parts.append(
            f"SELECT {i} AS ordinal, '{name}' AS \"column\", avg(CASE WHEN {num} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS r, "
            f"count({num}) AS n, sum(CASE WHEN {num} BETWEEN 1900 AND 2100 THEN 1 ELSE 0 END) AS y, "
            f"avg(length(coalesce({txt}, ''))) AS l FROM lineitem")
    return " UNION ALL ".join(parts)


_PROFILE_CTE = f"""
WITH raw AS ({_profile_sql()}),
prof AS (
  SELECT ordinal, "column", r AS numeric_ratio, coalesce(n > 0 AND y / n > 0.6, false) AS year_like, l AS mean_len
  FROM raw),
flags AS (
  SELECT *, numeric_ratio > 0.6 AND NOT year_like AS is_numeric, mean_len > 12 AND numeric_ratio < 0.3 AS is_texty
  FROM prof)
"""


@register("column_profile", _PROFILE_CTE + """
SELECT ordinal, "column", round(numeric_ratio, 6) AS numeric_ratio, year_like, round(mean_len, 6) AS mean_len,
       is_numeric, is_texty FROM flags
""")
def q_column_profile(spark, sf_dir):
    prof = column_profile(_profile_source(spark, sf_dir), per_file=False)
    return prof.select("ordinal", "column", F.round("numeric_ratio", 6).alias("numeric_ratio"), "year_like",
                       F.round("mean_len", 6).alias("mean_len"), "is_numeric", "is_texty")


@register("numeric_blocks", _PROFILE_CTE + """
, isl AS (SELECT *, ordinal - row_number() OVER (ORDER BY ordinal) AS island FROM flags WHERE is_numeric)
SELECT array_to_string(list("column" ORDER BY ordinal), ',') AS columns, min(ordinal) AS start_idx,
       max(ordinal) AS end_idx, max(ordinal) - min(ordinal) + 1 AS size
FROM isl GROUP BY island
""")
def q_numeric_blocks(spark, sf_dir):
    prof = column_profile(_profile_source(spark, sf_dir), per_file=False)
    blocks = numeric_blocks(prof)
    return blocks.select(F.array_join("columns", ",").alias("columns"), "start_idx", "end_idx", "size")


# ---------------------------------------------------------------------------------------------
# Preview, the first rows of every file (a limit that is the feature)


@register("preview_rows", """
SELECT 'lineitem_' || l_returnflag AS source_file, l_orderkey, l_linenumber, l_quantity
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) <= 10
""")
def q_preview_rows(spark, sf_dir):
    from ..operators.order import head_per_file
    li = table(spark, sf_dir, "lineitem")
    df = li.select(F.concat(F.lit("lineitem_"), "l_returnflag").alias(FILE), "l_orderkey", "l_linenumber",
                   "l_quantity", F.struct("l_orderkey", "l_linenumber").alias(ORD))
    return head_per_file(df, 10).drop(ORD)
