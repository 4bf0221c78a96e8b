"""Queries for outputs, run state and header maps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.aggregate import type_labels
from ..operators.lineage import FILE
from ..operators.project import apply_header_map, header_map_rows
from ..operators.validate import validate
from ..session import scratch_path
from ..sinks.outputs import latest, retry_paths, run_status, write_frame
from ..sources.rows import apply_metadata_headers
from ..spec import HeaderCell, JobSpec
from .catalog import register, table
from .combine import run_combine


@register("csv_output", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "' || c_mktsegment || '"' AS label, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer
""")
def q_csv_output(spark, sf_dir):
    """K2: text with commas and quotes written as CSV and read back."""
    c = table(spark, sf_dir, "customer")
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    path = write_frame(c.select("c_custkey", label.alias("label"), "c_nationkey"), scratch_path(spark, f"csv-out-{uuid.uuid4().hex}"), "csv")
    return spark.read.option("header", True).csv(path)


@register("combined_output", """
SELECT o_orderkey, o_custkey, o_totalprice, NULL AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'
""")
def q_combined_output(spark, sf_dir):
    """K3: the outputs of two jobs combined and written as one."""
    o = table(spark, sf_dir, "orders")
    root = scratch_path(spark, f"combined-{uuid.uuid4().hex}")
    done = F.col("o_orderstatus") == "F"
    write_frame(o.where(done).select("o_orderkey", "o_custkey", "o_totalprice"), f"{root}/in/a.parquet")
    write_frame(o.where(~done).select("o_orderkey", "o_custkey", "o_orderpriority"), f"{root}/in/b.parquet")
    return spark.read.parquet(write_frame(run_combine(spark, f"{root}/in"), f"{root}/all"))


def _ledger(spark, sf_dir):
    """Runs of files, one a user, out of events: every event is a run of its user's file."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("/in/f"), F.col("user_id").cast("string"), F.lit(".csv"))
    status = F.when(F.col("event_type").isin("error", "purchase"), "quarantined").otherwise("processed")
    return e.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias(FILE), status.alias("status"),
                    F.timestamp_seconds("event_id").cast("timestamp_ntz").alias("run_ts"))


_LAST = """
WITH l AS (SELECT '/in/f' || CAST(user_id AS VARCHAR) || '.csv' AS path, make_timestamp(event_id * 1000000) AS run_ts,
                  CASE WHEN event_type IN ('error', 'purchase') THEN 'quarantined' ELSE 'processed' END AS status FROM events),
last AS (SELECT path, max(run_ts) AS run_ts, arg_max(status, run_ts) AS status FROM l GROUP BY path)
"""


@register("run_state", _LAST + "SELECT status, count(*) AS files, max(run_ts) AS last_run FROM last GROUP BY status")
def q_run_state(spark, sf_dir):
    """K7: files by the status of their last run, and the latest run."""
    return run_status(_ledger(spark, sf_dir))


@register("retry_list", _LAST + "SELECT path FROM last WHERE status = 'quarantined'")
def q_retry_list(spark, sf_dir):
    """K8: inputs whose last run was quarantined."""
    return retry_paths(latest(_ledger(spark, sf_dir)))


@register("header_map", """
SELECT lower(c_mktsegment) || ' ' || CAST(c_custkey AS VARCHAR) AS source, 'field_' || CAST(c_nationkey AS VARCHAR) AS target
FROM customer WHERE c_custkey % 4 < 2
""")
def q_header_map(spark, sf_dir):
    """Mapping lines with either sign, comments and lines that are none."""
    c = table(spark, sf_dir, "customer")
    source = F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string"))
    target = F.concat(F.lit("field_"), F.col("c_nationkey").cast("string"))
    kind = F.col("c_custkey") % 4
    line = (F.when(kind == 0, F.concat(F.lit("  "), source, F.lit(" -> "), target, F.lit("  # own name")))
            .when(kind == 1, F.concat(source, F.lit(": "), target)).when(kind == 2, F.concat(F.lit("# "), source, F.lit(" -> "), target)).otherwise(source))
    return header_map_rows(c.select(line.alias("value")))


@register("header_map_applied", "SELECT c_custkey AS customer, c_name, c_acctbal AS balance FROM customer")
def q_header_map_applied(spark, sf_dir):
    """Columns renamed by a map whose source side is matched without regard to case."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return apply_header_map(c, {"C_CUSTKEY": "customer", "C_AcctBal": "balance", "absent": "x"})


@register("type_labels", """
SELECT 'event_id' AS "column", 'Number' AS label, count(event_id) AS cells FROM events UNION ALL SELECT 'ts', 'Date', count(ts) FROM events
UNION ALL SELECT 'event_type', 'Text', count(event_type) FROM events UNION ALL SELECT 'value', 'Number', count(value) FROM events
UNION ALL SELECT 'big', 'Boolean', count(value) FROM events
""")
def q_type_labels(spark, sf_dir):
    """C14: display types, with the filled cells of each column."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", (F.col("value") > 50).alias("big"))
    labels = type_labels(e)
    counts = e.agg(*[F.count(c).alias(c) for c, _ in labels])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(label).alias("label"), F.col(c).alias("cells")) for c, label in labels])))


@register("validation_off", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) || 'x' AS sales_amount, 0 AS errors FROM orders")
def q_validation_off(spark, sf_dir):
    """V5: with validation off, cells that would fail stay as they are and none is reported."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_totalprice").cast("string"), F.lit("x")).alias("sales_amount"))
    frame, errors = validate(o, JobSpec(field_types={"sales_amount": "float"}, required_fields=("sku",)), "off")
    return frame.withColumn("errors", F.lit(errors.count()))


@register("metadata_headers", """
SELECT 'orders_' || o_orderstatus AS source_file, CAST(o_orderkey AS VARCHAR) AS article_sku, o_orderpriority AS region FROM orders
""")
def q_metadata_headers(spark, sf_dir):
    """Sheets with a title row and two header rows; picked cells name the columns, the first pick of a column wins, data lie below the lowest."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("orders_"), "o_orderstatus")
    data = o.select(name.alias(FILE), (F.col("o_orderkey") + 3).alias("row"), F.array(F.col("o_orderkey").cast("string"), F.lit("-"), "o_orderpriority").alias("vals"))
    top = o.select(name.alias(FILE)).distinct().select(FILE, F.posexplode(F.array(
        F.array(F.lit("Report"), F.lit(None), F.lit(None)), F.array(F.lit("Key"), F.lit(None), F.lit(None)), F.array(F.lit("no."), F.lit("x"), F.lit("Region")))).alias("row", "vals"))
    cells = [HeaderCell("Key", 0, 1, alias="article_sku"), HeaderCell("no.", 0, 2), HeaderCell("Region", 2, 2, alias="region")]
    rows = data.unionByName(top.withColumn("row", F.col("row").cast("long")))
    return apply_metadata_headers(rows, cells).select(FILE, "article_sku", "region")
