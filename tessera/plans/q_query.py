"""Queries for the filter query (F1-F8, P10) and the stacking / merge operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.combine import merge_frames, stack_by_name, stack_strict
from ..operators.merge import merge_many
from ..operators.filters import Term, apply_filters, filter_sql
from ..operators.lineage import FILE
from ..operators.project import align_to, common_columns, project
from .catalog import register, table

# ---------------------------------------------------------------------------------------------
# F1-F8, P10


@register("filter_eq", """
SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3
""")
def q_filter_eq(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return apply_filters(li, [Term("l_returnflag", "=", "R"), Term("l_linenumber", "=", "3"),
                              Term("no_such_column", "=", "1"), Term("l_tax", "=", "")])


def _part_nullable_brand(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("brand"),
                    "p_size", "p_retailprice")


@register("filter_ne", """
SELECT * FROM (SELECT p_partkey, p_name, CASE WHEN p_size <= 45 THEN p_brand END AS brand, p_size, p_retailprice FROM part)
WHERE brand IS DISTINCT FROM 'Brand#2'
""")
def q_filter_ne(spark, sf_dir):
    return apply_filters(_part_nullable_brand(spark, sf_dir), [Term("brand", "!=", "Brand#2")])


@register("filter_gt", "SELECT * FROM lineitem WHERE l_quantity > 45")
def q_filter_gt(spark, sf_dir):
    return apply_filters(table(spark, sf_dir, "lineitem"), [("l_quantity", ">", "45")])


@register("filter_ge", "SELECT * FROM lineitem WHERE l_extendedprice >= 90000.5")
def q_filter_ge(spark, sf_dir):
    return apply_filters(table(spark, sf_dir, "lineitem"), [("l_extendedprice", ">=", "90000.5"),
                                                            ("l_quantity", ">=", "many")])


@register("filter_lt", "SELECT * FROM lineitem WHERE l_discount < 0.02 AND l_returnflag < 'N'")
def q_filter_lt(spark, sf_dir):
    return apply_filters(table(spark, sf_dir, "lineitem"), [("l_discount", "<", "0.02"),
                                                            ("l_returnflag", "<", "N")])


@register("filter_le", "SELECT * FROM lineitem WHERE l_shipdate <= '1996-01-01' AND l_tax <= 0.01")
def q_filter_le(spark, sf_dir):
    return apply_filters(table(spark, sf_dir, "lineitem"), [("l_shipdate", "<=", "1996-01-01"),
                                                            ("l_tax", "<=", "0.01")])


@register("filter_contains", """
SELECT * FROM (SELECT p_partkey, p_name, CASE WHEN p_size <= 45 THEN p_brand END AS brand, p_size, p_retailprice FROM part)
WHERE coalesce(regexp_matches(brand, 'd#1[0-9]$'), false) AND regexp_matches(p_name, 'ring|wid')
""")
def q_filter_contains(spark, sf_dir):
    return apply_filters(_part_nullable_brand(spark, sf_dir),
                         [Term("brand", "contains", "d#1[0-9]$"), Term("p_name", "contains", "ring|wid")])


@register("filter_sql", """
SELECT p_partkey, p_name, p_size FROM part WHERE p_name LIKE '%ring%' AND p_size > 20
""")
def q_filter_sql(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return filter_sql(spark, p, ["p_partkey", "p_name", "p_size"],
                      [Term("p_name", "contains", "ring"), Term("p_size", ">", "20")], view="part_q")


@register("filter_query", """
SELECT l_orderkey, l_partkey, l_extendedprice, l_shipdate FROM lineitem
WHERE l_returnflag <> 'N' AND l_quantity >= 10 AND l_quantity < 30 AND CAST(l_shipdate AS VARCHAR) LIKE '%-03-%'
""")
def q_filter_query(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = apply_filters(li, [Term("l_returnflag", "!=", "N"), Term("l_quantity", ">=", "10"),
                             Term("l_quantity", "<", "30"), Term("l_shipdate", "contains", "-03-")])
    return project(out, ["l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"])


# ---------------------------------------------------------------------------------------------
# U1 U2 U3 P7


def _orders_two_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice",
                                                      F.lit("orders_f").alias(FILE))
    b = o.where(F.col("o_orderstatus") != "F").select(
        "o_orderkey", "o_orderpriority", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.lit("orders_rest").alias(FILE))
    return a, b


@register("stack_by_name", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, 'orders_f' AS source_file,
       NULL AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL BY NAME
SELECT o_orderkey, 'C' || CAST(o_custkey AS VARCHAR) AS o_custkey, NULL AS o_totalprice, 'orders_rest' AS source_file,
       o_orderpriority FROM orders WHERE o_orderstatus <> 'F'
""")
def q_stack_by_name(spark, sf_dir):
    a, b = _orders_two_files(spark, sf_dir)
    return stack_by_name([a, b])


@register("stack_strict", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
""")
def q_stack_strict(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    parts = [o.where(F.col("o_orderdate") < "1998-01-01"), o.where(F.col("o_orderdate") >= "1998-01-01")]
    return stack_strict(parts, ["orders_early", "orders_late"])


@register("common_columns", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F'
""")
def q_common_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    frames = {
        "sheet_a": o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice",
                                                                 "o_orderdate"),
        "sheet_b": o.where(F.col("o_orderstatus") != "F").select("o_orderdate", "o_orderkey", "o_orderstatus"),
    }
    shared, _ = common_columns(frames)
    return stack_by_name([align_to(f, shared) for f in frames.values()])


# ---------------------------------------------------------------------------------------------
# J1-J4


def _merge_inputs(spark, sf_dir):
    """Orders to customers to suppliers on a key that grows with the data; a third of the orders share one key, some have none."""
    o, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    orders = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
                      .cast("long").alias("custkey"), F.col("o_totalprice").alias("acctbal"))
    cust = c.select(F.when(F.col("c_custkey") != 2, F.col("c_custkey")).cast("long").alias("custkey"), "c_name", F.col("c_acctbal").alias("acctbal"))
    supp = s.select(F.col("s_suppkey").cast("long").alias("custkey"), "s_name", F.col("s_acctbal").alias("acctbal"))
    return orders, cust, supp


_ORD = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey, "
        "o_totalprice AS acctbal FROM orders)")
_CUST = "(SELECT CASE WHEN c_custkey <> 2 THEN c_custkey END AS custkey, c_name, c_acctbal AS acctbal FROM customer)"
_SUPP = "(SELECT s_suppkey AS custkey, s_name, s_acctbal AS acctbal FROM supplier)"


def _merge_sql(join: str, key: str) -> str:
    return f"""
SELECT l.o_orderkey, CAST({key} AS BIGINT) AS custkey, l.acctbal, r.c_name, r.acctbal AS acctbal_2
FROM {_ORD} l {join} {_CUST} r ON l.custkey IS NOT DISTINCT FROM r.custkey
"""


@register("merge_inner", _merge_sql("JOIN", "l.custkey"))
def q_merge_inner(spark, sf_dir):
    orders, cust, _ = _merge_inputs(spark, sf_dir)
    return merge_frames([orders, cust], ["custkey"], "inner")


@register("merge_left", _merge_sql("LEFT JOIN", "l.custkey"))
def q_merge_left(spark, sf_dir):
    orders, cust, _ = _merge_inputs(spark, sf_dir)
    return merge_frames([orders, cust], ["custkey"], "left")


@register("merge_right", _merge_sql("RIGHT JOIN", "r.custkey"))
def q_merge_right(spark, sf_dir):
    orders, cust, _ = _merge_inputs(spark, sf_dir)
    return merge_frames([orders, cust], ["custkey"], "right")


@register("merge_outer", _merge_sql("FULL JOIN", "coalesce(l.custkey, r.custkey)"))
def q_merge_outer(spark, sf_dir):
    orders, cust, _ = _merge_inputs(spark, sf_dir)
    return merge_frames([orders, cust], ["custkey"], "outer")


@register("merge_three", f"""
SELECT m.*, n.s_name, n.acctbal AS acctbal_3
FROM ({_merge_sql("LEFT JOIN", "l.custkey")}) m LEFT JOIN {_SUPP} n ON m.custkey IS NOT DISTINCT FROM n.custkey
""")
def q_merge_three(spark, sf_dir):
    return merge_frames(list(_merge_inputs(spark, sf_dir)), ["custkey"], "left")


def _six_inputs(spark, sf_dir):
    """Six inputs on customer numbers; a third of the orders have no key, and so has one row of each other input."""
    o, c, s, e, p, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "events", "part", "lineitem"))
    key = lambda c, none: F.when(none, None).otherwise(c).cast("long").alias("k")
    return [
        o.select(key(F.col("o_custkey"), F.col("o_orderkey") % 3 == 0), "o_orderkey", F.col("o_totalprice").alias("v")),
        c.select(key(F.col("c_custkey"), F.col("c_custkey") == 7), "c_name", F.col("c_acctbal").alias("v")),
        s.select(key(F.col("s_suppkey"), F.col("s_suppkey") == 3), "s_name", F.col("s_acctbal").alias("v")),
        e.groupBy(key(F.col("user_id"), F.col("user_id") == 5)).agg(F.count(F.lit(1)).alias("events")),
        p.select(key(F.col("p_partkey"), F.col("p_partkey") == 9), "p_name"),
        li.groupBy(key(F.col("l_suppkey"), F.col("l_suppkey") == 2)).agg(F.sum("l_quantity").alias("v"))]


_SIX = {
    "a": "(SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k, o_orderkey, o_totalprice AS v FROM orders)",
    "b": "(SELECT CASE WHEN c_custkey <> 7 THEN c_custkey END AS k, c_name, c_acctbal AS v FROM customer)",
    "c": "(SELECT CASE WHEN s_suppkey <> 3 THEN s_suppkey END AS k, s_name, s_acctbal AS v FROM supplier)",
    "d": "(SELECT CASE WHEN user_id <> 5 THEN user_id END AS k, count(*) AS events FROM events GROUP BY 1)",
    "e": "(SELECT CASE WHEN p_partkey <> 9 THEN p_partkey END AS k, p_name FROM part)",
    "f": "(SELECT CASE WHEN l_suppkey <> 2 THEN l_suppkey END AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1)",
}


def _six_sql(how: str) -> str:
    """The left fold, a join a step."""
    key = {"inner": "l.k", "left": "l.k", "right": "r.k", "outer": "coalesce(l.k, r.k)"}[how]
    join = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}[how]
    cols, sql = ["o_orderkey", "v"], f"SELECT k, o_orderkey, v FROM {_SIX['a']}"
    for t, new in (("b", "c_name, r.v AS v_2"), ("c", "s_name, r.v AS v_3"), ("d", "events"), ("e", "p_name"), ("f", "r.v AS v_6")):
        sql = f"SELECT {key} AS k, {', '.join('l.' + c for c in cols)}, r.{new.removeprefix('r.')} FROM ({sql}) l {join} {_SIX[t]} r ON l.k IS NOT DISTINCT FROM r.k"
        cols += [x.split(" AS ")[-1].removeprefix("r.") for x in new.split(", ")]
    return f"SELECT CAST(k AS BIGINT) AS k, {', '.join(cols)} FROM ({sql})"


def _register_six(how: str) -> None:
    @register(f"merge_six_{how}", _six_sql(how))
    def query(spark, sf_dir):
        return merge_many(_six_inputs(spark, sf_dir), ["k"], how)


for _how in ("inner", "left", "right", "outer"):
    _register_six(_how)


@register("stack_widen", """
SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS v, 'o' AS part FROM orders
UNION ALL SELECT l_orderkey, CAST(l_linenumber AS DOUBLE), 'l' FROM lineitem
""")
def q_stack_widen(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("o").alias("part"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("int").alias("k"), F.col("l_linenumber").cast("int").alias("v"), F.lit("l").alias("part"))
    return stack_by_name([o, li])


@register("unpivot_widen", """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, CAST(l_quantity AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_suppkey', CAST(l_suppkey AS DOUBLE) FROM lineitem
""")
def q_unpivot_widen(spark, sf_dir):
    from ..operators.reshape import unpivot

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), "l_suppkey")
    return unpivot(li, ["l_orderkey", "l_linenumber"], "measure", "value")[0]


# ---------------------------------------------------------------------------------------------
# S1 S12 S16 on files Spark writes from a table (one header line per part file)


@register("csv_scan", """
SELECT o_orderkey, o_custkey, o_totalprice AS sales_amount, CAST(o_orderdate AS TIMESTAMP) AS report_date,
       o_orderpriority FROM orders
""")
def q_csv_scan(spark, sf_dir):
    import uuid

    from ..operators.clean import coerce_types
    from ..session import scratch_path
    from ..sources.csv import read_csv
    from ..spec import JobSpec

    o = table(spark, sf_dir, "orders")
    path = scratch_path(spark, f"csv-scan-{uuid.uuid4().hex}")
    (o.select("o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice",
              F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
      .repartition(4).write.option("header", True).csv(path))
    spec = JobSpec(source_type="csv",
                   columns=("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"),
                   column_mappings={"o_totalprice": "sales_amount", "o_orderdate": "report_date"},
                   field_types={"o_orderkey": "int", "o_custkey": "int", "sales_amount": "float",
                                "report_date": "date"})
    typed, _ = coerce_types(read_csv(spark, path, spec), spec.field_types)
    return typed.select("o_orderkey", "o_custkey", "sales_amount", "report_date", "o_orderpriority")
