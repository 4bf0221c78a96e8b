"""Queries for the transform chain: projections, reshape, cleaning, types, group sum, dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import header_norm, month_token, snake_case, year_month_label
from ..operators.aggregate import group_sum, provider_totals
from ..operators.clean import coerce_types, failure_counts, strip_thousands_text, trim_text
from ..operators.filters import drop_empty_rows, drop_sparse_columns, drop_null_dates
from ..operators.lineage import FILE, KEY, ORD
from ..operators.order import dedupe_first, strip_lineage
from ..operators.project import (filter_and_rename, replace_headers, stamp_provider)
from ..operators.reshape import unpivot
from ..functions import parse_timestamp, to_num
from ..spec import HeaderCell, JobSpec
from .catalog import r2, register, table
from .transform import transform

# ---------------------------------------------------------------------------------------------
# flagship: the whole template chain over lineitem

FLAGSHIP_SPEC = JobSpec(
    columns=("l_partkey", "l_shipdate", "qty", "amount"),
    column_mappings={"l_partkey": "article_sku", "l_shipdate": "report_date"},
    provider_name="tpch",
    unpivot=True,
    var_name="measure",
    value_name="sales_amount",
    strip_thousands=True,
    combine_on=("article_sku",),
    dedupe_on=("article_sku", "measure"),
)


def flagship_source(spark, sf_dir):
    """lineitem as a messy sheet: text dates (returned lines carry 'n/a'), text amounts with
    thousands separators."""
    li = table(spark, sf_dir, "lineitem", lineage=True)
    return li.select(
        "l_partkey",
        F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("l_shipdate"),
        F.col("l_quantity").alias("qty"),
        F.format_number("l_extendedprice", 2).alias("amount"),
        FILE, ORD)


@register("full_job", """
SELECT l_partkey AS article_sku, measure, 'tpch' AS provider_id, round(sum(v), 2) AS sales_amount
FROM (
  SELECT l_partkey, 'qty' AS measure, l_quantity AS v FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL
  SELECT l_partkey, 'amount' AS measure, l_extendedprice AS v FROM lineitem WHERE l_returnflag <> 'R'
) GROUP BY l_partkey, measure
""")
def q_full_job(spark, sf_dir):
    src = filter_and_rename(flagship_source(spark, sf_dir), FLAGSHIP_SPEC)
    out = transform(src, FLAGSHIP_SPEC).frame
    return out.select("article_sku", "measure", "provider_id", r2("sales_amount").alias("sales_amount"))


# ---------------------------------------------------------------------------------------------
# P1 P2 P3 P4 P9

@register("rename_select", """
SELECT o_orderkey AS order_id, o_custkey, o_totalprice AS sales_amount FROM orders
""")
def q_rename_select(spark, sf_dir):
    spec = JobSpec(columns=("o_orderkey", "o_custkey", "o_totalprice", "o_missing"),
                   column_mappings={"o_orderkey": "order_id", "o_totalprice": "sales_amount"})
    return strip_lineage(filter_and_rename(table(spark, sf_dir, "orders"), spec))


@register("positional_rename", """
SELECT c_name AS customer, c_custkey AS customer_id, c_mktsegment AS Segment FROM customer
""")
def q_positional_rename(spark, sf_dir):
    spec = JobSpec(headers=(HeaderCell("Name", 1, 0, alias="customer"), HeaderCell("Key", 0, 0),
                            HeaderCell("Segment", 4, 0)),
                   column_mappings={"Key": "customer_id"})
    return filter_and_rename(table(spark, sf_dir, "customer"), spec)


@register("headers_replaced", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal, c_mktsegment FROM customer
""")
def q_headers_replaced(spark, sf_dir):
    return replace_headers(table(spark, sf_dir, "customer"), ["id", "name", "nation"])


@register("provider_stamp", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier.parquet' AS provider_id FROM supplier
""")
def q_provider_stamp(spark, sf_dir):
    df = stamp_provider(table(spark, sf_dir, "supplier", lineage=True), JobSpec())
    return df.drop(FILE, ORD, KEY)


# ---------------------------------------------------------------------------------------------
# R1

@register("unpivot_measures", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem)
SELECT l_orderkey, l_linenumber, measure, value
FROM s UNPIVOT INCLUDE NULLS (value FOR measure IN (l_quantity, l_extendedprice, l_discount))
""")
def q_unpivot_measures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice", "l_discount")
    out, _ = unpivot(li, ["l_orderkey", "l_linenumber"], "measure", "value")
    return out


# ---------------------------------------------------------------------------------------------
# F9 F10

def _orders_with_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders", lineage=True)
    low = F.col("o_orderpriority") == "5-LOW"
    return o.select(
        F.when(~low, F.col("o_orderkey")).alias("order_ref"),
        F.when(~low & (F.col("o_orderpriority") != "4-NOT SPECIFIED"), F.col("o_orderstatus")).alias("status"),
        F.when(~low, F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("note"),
        FILE, ORD)


@register("drop_empty_rows", """
SELECT order_ref, status, amount, note FROM (
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS order_ref,
         CASE WHEN o_orderpriority <> '5-LOW' AND o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderstatus END AS status,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS amount,
         CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS note
  FROM orders)
WHERE NOT (order_ref IS NULL AND status IS NULL AND amount IS NULL AND note IS NULL)
""")
def q_drop_empty_rows(spark, sf_dir):
    return drop_empty_rows(_orders_with_gaps(spark, sf_dir)).drop(FILE, ORD, KEY)


@register("drop_sparse_columns", """
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS order_ref,
       CASE WHEN o_orderpriority <> '5-LOW' AND o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderstatus END AS status,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS amount
FROM orders
""")
def q_drop_sparse_columns(spark, sf_dir):
    return drop_sparse_columns(_orders_with_gaps(spark, sf_dir), 0.5).drop(FILE, ORD, KEY)


# ---------------------------------------------------------------------------------------------
# C1 C2 C3 C4 F11

@register("trim_text", r"""
SELECT p_partkey,
       regexp_replace(concat('  ', p_name, chr(9), ' '), '^\s+|\s+$', '', 'g') AS name,
       regexp_replace(concat(chr(10), p_brand), '^\s+|\s+$', '', 'g') AS brand,
       p_size
FROM part
""")
def q_trim_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    df = p.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("\t ")).alias("name"),
                  F.concat(F.lit("\n"), "p_brand").alias("brand"), "p_size")
    return trim_text(df)


@register("strip_thousands", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, l_returnflag AS flag FROM lineitem
""")
def q_strip_thousands(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = li.select("l_orderkey", "l_linenumber",
                   F.format_number("l_extendedprice", 2).alias("price"),
                   F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("flag"))
    df = strip_thousands_text(df)
    return df.withColumn("price", to_num("price"))


def _orders_text_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders", lineage=True)
    prio = F.col("o_orderpriority")
    text = (F.when(prio == "1-URGENT", F.lit("soon"))
             .when(prio == "2-HIGH", F.lit(None).cast("string"))
             .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select("o_orderkey", text.alias("report_date"), FILE, ORD)


@register("parse_date_drop", """
SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS report_date
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
""")
def q_parse_date_drop(spark, sf_dir):
    df = _orders_text_dates(spark, sf_dir)
    df = df.withColumn("report_date", parse_timestamp("report_date"))
    return drop_null_dates(df, "report_date").drop(FILE, ORD, KEY)


@register("amount_fill_zero", """
SELECT l_orderkey, l_linenumber,
       coalesce(try_cast(CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS DOUBLE), 0.0) AS sales_amount
FROM lineitem
""")
def q_amount_fill_zero(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    txt = F.when(F.col("l_returnflag") == "N", F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string"))
    df = li.select("l_orderkey", "l_linenumber", txt.alias("sales_amount"))
    return df.withColumn("sales_amount", F.coalesce(to_num("sales_amount"), F.lit(0.0)))


# ---------------------------------------------------------------------------------------------
# C5-C8 V6 on lineitem as text with bad cells

TYPE_MAP = {"quantity": "int", "price": "float", "shipped": "date", "line": "text", "flag": "unknown"}


def _lineitem_as_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(flag == "A", (F.col("l_quantity") + 0.5).cast("string"))
         .otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(flag == "R", F.lit("abc")).otherwise(F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(F.col("l_linestatus") == "O", F.lit("31.02.1999"))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("shipped"),
        F.col("l_linenumber").alias("line"),
        flag.alias("flag"))


@register("typed_int", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity
FROM lineitem
""")
def q_typed_int(spark, sf_dir):
    df, _ = coerce_types(_lineitem_as_text(spark, sf_dir), TYPE_MAP)
    return df.select("l_orderkey", "l_linenumber", "quantity")


@register("typed_float", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS price
FROM lineitem
""")
def q_typed_float(spark, sf_dir):
    df, _ = coerce_types(_lineitem_as_text(spark, sf_dir), TYPE_MAP)
    return df.select("l_orderkey", "l_linenumber", "price")


@register("typed_date", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS shipped
FROM lineitem
""")
def q_typed_date(spark, sf_dir):
    df, _ = coerce_types(_lineitem_as_text(spark, sf_dir), TYPE_MAP)
    return df.select("l_orderkey", "l_linenumber", "shipped")


@register("typed_text", """
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag FROM lineitem
""")
def q_typed_text(spark, sf_dir):
    df, _ = coerce_types(_lineitem_as_text(spark, sf_dir), TYPE_MAP)
    return df.select("l_orderkey", "line", "flag")


@register("type_failures", """
SELECT * FROM (
  SELECT 'quantity' AS "column", 'int' AS type, count(*) FILTER (WHERE l_returnflag = 'A') AS failures FROM lineitem
  UNION ALL SELECT 'price', 'float', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem
  UNION ALL SELECT 'shipped', 'date', count(*) FILTER (WHERE l_linestatus = 'O') FROM lineitem
) WHERE failures > 0
""")
def q_type_failures(spark, sf_dir):
    return failure_counts(_lineitem_as_text(spark, sf_dir), TYPE_MAP)


# ---------------------------------------------------------------------------------------------
# C9-C12 on labels derived from part and orders

def _part_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws("", "p_name", F.lit(" / "), "p_type", F.lit("-"), "p_brand",
                                            F.lit(" (size "), F.col("p_size").cast("string"), F.lit(")"))
                    .alias("label"))


_LABEL_SQL = "concat(p_name, ' / ', p_type, '-', p_brand, ' (size ', CAST(p_size AS VARCHAR), ')')"


@register("snake_case", f"""
SELECT p_partkey, lower(trim(regexp_replace(regexp_replace({_LABEL_SQL}, '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '_')) AS label
FROM part
""")
def q_snake_case(spark, sf_dir):
    df = _part_labels(spark, sf_dir)
    return df.select("p_partkey", snake_case("label").alias("label"))


@register("header_norm", rf"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({_LABEL_SQL}), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS label
FROM part
""")
def q_header_norm(spark, sf_dir):
    df = _part_labels(spark, sf_dir)
    return df.select("p_partkey", header_norm("label").alias("label"))


# Month words per language used to write month headers in the derived sheets.
MONTH_SPELLINGS = {
    "1-URGENT": ["tammikuu", "helmikuu", "maaliskuu", "huhtikuu", "toukokuu", "kesäkuu",
                 "heinäkuu", "elokuu", "syyskuu", "lokakuu", "marraskuu", "joulukuu"],
    "2-HIGH": ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"],
    "3-MEDIUM": ["Januari", "Februari", "Mars", "April", "Maj", "Juni", "Juli", "Augusti",
                 "September", "Oktober", "November", "December"],
    "4-NOT SPECIFIED": ["Januar", "Februar", "März", "Apr.", "Mai", "Jun.", "Jul.", "Aug.",
                        "Sept.", "Okt.", "Nov.", "Dezember"],
    "5-LOW": ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"],
}


def _token_expr():
    expr = None
    for prio, words in MONTH_SPELLINGS.items():
        arr = F.array(*[F.lit(w) for w in words])
        val = F.element_at(arr, F.month("o_orderdate"))
        cond = F.col("o_orderpriority") == prio
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def _token_sql() -> str:
    parts = []
    for prio, words in MONTH_SPELLINGS.items():
        lst = ", ".join("'" + w + "'" for w in words)
        parts.append(f"WHEN o_orderpriority = '{prio}' THEN [{lst}][month(o_orderdate)]")
    return "CASE " + " ".join(parts) + " END"


def _month_sql(token: str) -> str:
    from ..functions.text import MONTH_ABBREVIATIONS, MONTH_WORDS
    words = " ".join(f"WHEN lower({token}) = '{w}' THEN '{m}'" for w, m in MONTH_WORDS.items())
    abbr = " ".join(f"WHEN contains(lower({token}), '{a}') THEN '{a}'" for a in MONTH_ABBREVIATIONS)
    return f"CASE {words} {abbr} END"


@register("month_token", f"""
SELECT o_orderkey, token, {_month_sql('token')} AS month
FROM (SELECT o_orderkey, {_token_sql()} AS token FROM orders)
""")
def q_month_token(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    df = o.select("o_orderkey", _token_expr().alias("token"))
    return df.select("o_orderkey", "token", month_token("token").alias("month"))


@register("year_month_label", f"""
SELECT o_orderkey, CASE WHEN has_year AND {_month_sql('token')} IS NOT NULL
                        THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || {_month_sql('token')}
                        ELSE label END AS label
FROM (
  SELECT o_orderkey, o_orderdate, {_token_sql()} AS token, o_orderstatus <> 'P' AS has_year,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS VARCHAR) || '/' || {_token_sql()}
              ELSE 'Q-' || {_token_sql()} END AS label
  FROM orders)
""")
def q_year_month_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    token = _token_expr()
    label = F.when(F.col("o_orderstatus") != "P",
                   F.concat(F.year("o_orderdate").cast("string"), F.lit("/"), token)) \
             .otherwise(F.concat(F.lit("Q-"), token))
    return o.select("o_orderkey", year_month_label(label).alias("label"))


# ---------------------------------------------------------------------------------------------
# A1 A2 D1

@register("group_sum", """
SELECT cust AS o_custkey, 'orders.parquet' AS provider_id, sum(o_orderkey) AS o_orderkey,
       round(sum(o_totalprice), 2) AS o_totalprice
FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS cust, * FROM orders)
WHERE cust IS NOT NULL GROUP BY cust
""")
def q_group_sum(spark, sf_dir):
    o = table(spark, sf_dir, "orders", lineage=True)
    o = o.withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    df = stamp_provider(o, JobSpec())
    out = group_sum(df, ["o_custkey"])
    return out.select("o_custkey", "provider_id", "o_orderkey", r2("o_totalprice").alias("o_totalprice"))


@register("provider_totals", """
SELECT CAST(l_suppkey AS VARCHAR) AS provider_id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_sales_amount
FROM lineitem GROUP BY l_suppkey
""")
def q_provider_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = li.select(F.col("l_suppkey").cast("string").alias("provider_id"),
                   (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales_amount"))
    out = provider_totals(df)
    return out.select("provider_id", r2("total_sales_amount").alias("total_sales_amount"))


@register("dedupe_first", """
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def q_dedupe_first(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ev = ev.withColumn(ORD, F.struct("ts", "event_id"))
    return dedupe_first(ev, ["user_id"]).drop(ORD)


@register("dedupe_null_keys", """
SELECT event_id, ts, k AS user_id, event_type FROM (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS k, event_type FROM events)
QUALIFY row_number() OVER (PARTITION BY k, event_type ORDER BY ts, event_id) = 1
""")
def q_dedupe_null_keys(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ev = ev.select("event_id", "ts",
                   F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
                   "event_type", F.struct("ts", "event_id").alias(ORD))
    return dedupe_first(ev, ["user_id", "event_type"]).drop(ORD)


@register("guessed_date_layouts", """
SELECT 'orders_' || o_orderstatus AS source_file, o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS report_date,
       o_orderkey % 17 = 0 AS bad FROM orders
""")
def q_guessed_date_layouts(spark, sf_dir):
    """Three files, the day first, the month first and in words; some cells that are no dates."""
    from ..operators.layouts import parse_dates

    o = table(spark, sf_dir, "orders")
    layout = {"F": "dd/MM/yyyy", "O": "MM/dd/yyyy", "P": "d MMM yyyy"}
    text = F.coalesce(*[F.when(F.col("o_orderstatus") == s, F.date_format("o_orderdate", f)) for s, f in layout.items()])
    src = o.select(F.concat(F.lit("orders_"), "o_orderstatus").alias(FILE), "o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, "pending").otherwise(text).alias("text"))
    out = parse_dates(src, ["text"], suffix="_day")
    return out.select(FILE, "o_orderkey", F.col("text_day").alias("report_date"), (F.col("text").isNotNull() & F.col("text_day").isNull()).alias("bad"))
