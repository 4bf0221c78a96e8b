"""Queries for the whole job (S1, S12, S15, S16, K1-K6, V4): unlike files written from the tables, one run, its outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import FILE
from ..session import scratch_path
from ..sources.csv import read_csv
from ..sources.files import company_of, pair_specs
from ..spec import JobSpec
from .catalog import register, table
from .job import run_job

SPEC = JobSpec(source_type="csv", column_mappings={"sku": "article_sku", "amount": "sales_amount", "date": "report_date"},
               columns=("sku", "amount", "date"), provider_name="p", strip_thousands=True, required_fields=("article_sku",))


def _inputs(spark, sf_dir):
    """Orders as CSV files of three companies: columns in other orders and more of them, thousands separators in quotes,
    missing dates, and one company without the required column."""
    o = table(spark, sf_dir, "orders")
    root = scratch_path(spark, f"job-{uuid.uuid4().hex}")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cents = F.format_number("o_totalprice", 2)
    parts = {
        "acme": o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sku"), F.col("o_totalprice").alias("amount"), day.alias("date"), F.col("o_orderpriority").alias("note")),
        "beta": o.where("o_orderstatus = 'O'").select(day.alias("date"), cents.alias("amount"), F.col("o_custkey").alias("sku")),
        "gamma": o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sku"), F.when(F.col("o_orderkey") % 7 == 0, "N/A").otherwise(day).alias("date"), cents.alias("amount")),
        "delta": o.select(F.col("o_custkey").alias("code"), F.col("o_totalprice").alias("amount"), day.alias("date")),
    }
    for name, df in parts.items():
        df.write.option("header", True).csv(f"{root}/in/{name}")
    return root


def _run(spark, sf_dir):
    root = _inputs(spark, sf_dir)
    return root, run_job(spark, SPEC, f"{root}/in", f"{root}/out", kind="csv", level="contract", root=f"{root}/in")


_ROWS = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'acme' WHEN 'O' THEN 'beta' ELSE 'gamma' END AS company, o_orderkey, o_custkey, o_totalprice, o_orderdate,
       o_orderstatus = 'P' AND o_orderkey % 7 = 0 AS dateless FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')
"""


@register("job_clean", f"""
SELECT company, CAST(o_custkey AS VARCHAR) AS article_sku, CAST(o_totalprice AS DOUBLE) AS sales_amount, CAST(o_orderdate AS TIMESTAMP) AS report_date, 'p' AS provider_id
FROM ({_ROWS}) WHERE NOT dateless
""")
def q_job_clean(spark, sf_dir):
    _, res = _run(spark, sf_dir)
    return spark.read.parquet(res.clean_path).select("company", "article_sku", "sales_amount", "report_date", "provider_id")


@register("job_ledger", f"""
SELECT company, 'processed' AS status, CAST(count(*) AS BIGINT) AS rows_in, CAST(count(*) FILTER (NOT dateless) AS BIGINT) AS rows_out, CAST(0 AS BIGINT) AS errors_files
FROM ({_ROWS}) GROUP BY company
UNION ALL SELECT 'delta', 'quarantined', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM orders
""")
def q_job_ledger(spark, sf_dir):
    root, res = _run(spark, sf_dir)
    led = res.ledger.where("rows_in > 0").withColumn("company", company_of(F.col("path"), f"{root}/in"))
    return led.groupBy("company", "status").agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"),
                                                F.max((F.col("errors") > 0).cast("long")).alias("errors_files"))


@register("job_quarantine", """
SELECT 'delta' AS company, CAST(o_totalprice AS DOUBLE) AS sales_amount, 'Validation failed.' AS reason FROM orders
""")
def q_job_quarantine(spark, sf_dir):
    _, res = _run(spark, sf_dir)
    q = spark.read.parquet(res.quarantine_path).where("sales_amount IS NOT NULL")
    return q.select("company", F.col("sales_amount").cast("double").alias("sales_amount"), "reason")


def _listing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    folder = F.concat(F.lit("/in/"), "c_mktsegment", F.lit("/n"), F.col("c_nationkey").cast("string"))
    stem = F.concat(F.lit("f"), F.col("c_custkey").cast("string"))
    kinds = [(None, "csv", ""), (10, "json", ".df-template"), (15, "yaml", ".df-template")]
    parts = [c.where(F.col("c_custkey") % n == 0 if n else F.lit(True)).select(
        F.concat(folder, F.lit("/"), stem, F.lit(f"{mark}.{ext}")).alias("path"), F.concat(stem, F.lit(f"{mark}.{ext}")).alias(FILE),
        folder.alias("dir"), F.lit(ext).alias("ext"), stem.alias("stem")) for n, ext, mark in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("folder_pairing", """
WITH d AS (SELECT c_custkey AS k, '/in/' || c_mktsegment || '/n' || CAST(c_nationkey AS VARCHAR) AS dir, 'f' || CAST(c_custkey AS VARCHAR) AS stem FROM customer),
s AS (SELECT dir, stem, 1 AS rank, stem || '.df-template.json' AS file FROM d WHERE k % 10 = 0
      UNION ALL SELECT dir, stem, 2, stem || '.df-template.yaml' FROM d WHERE k % 15 = 0),
own AS (SELECT dir, stem, min_by(file, rank) AS file FROM s GROUP BY ALL),
folder AS (SELECT dir, min_by(file, (rank, file)) AS file FROM s GROUP BY ALL)
SELECT d.dir || '/' || d.stem || '.csv' AS path, d.dir || '/' || coalesce(own.file, folder.file) AS spec_path
FROM d LEFT JOIN own ON d.dir = own.dir AND d.stem = own.stem LEFT JOIN folder ON d.dir = folder.dir
""")
def q_folder_pairing(spark, sf_dir):
    return pair_specs(_listing(spark, sf_dir)).select("path", "spec_path")


@register("csv_messy", """
SELECT o_orderkey, 'said "' || o_orderpriority || '", then' || chr(10) || 'left, ' || CAST(o_custkey AS VARCHAR) AS note,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status FROM orders
""")
def q_csv_messy(spark, sf_dir):
    path = scratch_path(spark, f"csv-messy-{uuid.uuid4().hex}")
    note = F.concat(F.lit('said "'), "o_orderpriority", F.lit('", then\nleft, '), F.col("o_custkey").cast("string"))
    mark = F.element_at(F.array(*[F.lit(m) for m in ("NA", "null", "N/A", "nan")]), (F.col("o_orderkey") / 4 % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).otherwise(mark).alias("status"))
    o.write.option("header", True).option("escape", '"').csv(path)
    rows = read_csv(spark, path, JobSpec(source_type="csv", multiline=True, csv_width=3))
    return rows.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", "status")


ROWS_SPEC = JobSpec(columns=("o_custkey", "day", "amount", "note"), column_mappings={"o_custkey": "article_sku", "day": "report_date", "amount": "sales_amount"},
                    provider_name="tpch", strip_thousands=True, drop_empty_rows=True, drop_null_columns_threshold=0.5, dedupe_on=("article_sku",))


@register("full_job_rows", """
SELECT o_custkey AS article_sku, CAST(o_orderdate AS TIMESTAMP) AS report_date, CAST(o_totalprice AS DOUBLE) AS sales_amount, 'tpch' AS provider_id
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
""")
def q_full_job_rows(spark, sf_dir):
    """The row-wise chain: empty rows, a sparse column, unreadable dates and repeated keys all go."""
    from ..operators.lineage import ORD
    from ..operators.project import filter_and_rename
    from .transform import transform

    o = table(spark, sf_dir, "orders")
    there = F.col("o_orderkey") % 11 != 0
    src = o.select(F.when(there, F.col("o_custkey")).alias("o_custkey"),
                   F.when(there, F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("day"),
                   F.when(there, F.format_number("o_totalprice", 2)).alias("amount"), F.when(there & (F.col("o_orderkey") % 10 == 0), F.lit("x")).alias("note"),
                   F.lit("orders").alias(FILE), F.struct(F.col("o_orderkey").alias("i")).alias(ORD))
    out = transform(filter_and_rename(src, ROWS_SPEC), ROWS_SPEC).frame
    return out.select("article_sku", "report_date", "sales_amount", "provider_id", *[c for c in out.columns if c == "note"])


def _unlike_folder(spark, sf_dir):
    """Orders as five inputs of different columns and types, each a folder of several files."""
    o = table(spark, sf_dir, "orders")
    root = scratch_path(spark, f"unlike-{uuid.uuid4().hex}")
    whole = F.col("o_custkey")
    parts = {
        "a": o.select("o_orderkey", whole.cast("long").alias("v")), "b": o.select(F.col("o_orderpriority").alias("note"), "o_orderkey"),
        "c": o.select(whole.cast("string").alias("v"), "o_orderkey", "o_orderstatus"), "d": o.select("o_orderkey", whole.cast("int").alias("v")),
        "e": o.select("o_orderkey", F.length("o_orderpriority").alias("n"))}
    for name, df in parts.items():
        df.repartition(4).write.parquet(f"{root}/{name}.parquet")
    return root


@register("stack_unlike_files", """
SELECT 'a.parquet' AS source_file, o_orderkey, CAST(o_custkey AS VARCHAR) AS v, NULL AS note, NULL AS o_orderstatus, NULL AS n FROM orders
UNION ALL SELECT 'b.parquet', o_orderkey, NULL, o_orderpriority, NULL, NULL FROM orders
UNION ALL SELECT 'c.parquet', o_orderkey, CAST(o_custkey AS VARCHAR), NULL, o_orderstatus, NULL FROM orders
UNION ALL SELECT 'd.parquet', o_orderkey, CAST(o_custkey AS VARCHAR), NULL, NULL, NULL FROM orders
UNION ALL SELECT 'e.parquet', o_orderkey, NULL, NULL, NULL, CAST(length(o_orderpriority) AS INT) FROM orders
""")
def q_stack_unlike_files(spark, sf_dir):
    """A folder of unlike outputs, one scan per distinct schema."""
    from .combine import run_combine

    return run_combine(spark, _unlike_folder(spark, sf_dir), lineage=True)


@register("preflight_footers", """
SELECT o_orderpriority AS folder, CAST(count(*) AS BIGINT) AS "rows", 2 AS columns, 'OK' AS status FROM orders GROUP BY 1
""")
def q_preflight_footers(spark, sf_dir):
    """A9, A10 of Parquet files from their footers."""
    from ..sources.files import list_files
    from ..sources.footers import preflight_footers

    root = scratch_path(spark, f"footers-{uuid.uuid4().hex}")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("p")).write.partitionBy("p").parquet(root)
    files = preflight_footers(list_files(spark, root))
    folder = F.try_url_decode(F.regexp_extract("path", "/p=([^/]+)/", 1))
    return files.groupBy(folder.alias("folder")).agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.max("status").alias("status"))


@register("stream_replay", """
SELECT o_orderstatus AS company, CAST(o_custkey AS VARCHAR) AS article_sku, CAST(o_totalprice AS DOUBLE) AS sales_amount, 'processed' AS status
FROM orders
""")
def q_stream_replay(spark, sf_dir):
    """Slices of orders arrive in a drop folder before three triggers; the second trigger's batch is handed in again, and the third sees
    a folder that holds every file of the first two, too."""
    from ..sinks.commit import published
    from ..streaming.incremental import commit_batch, start_committed

    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    spec = JobSpec(source_type="csv", column_mappings={"sku": "article_sku", "amount": "sales_amount"}, columns=("sku", "amount"), provider_name="p")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").alias("sku"), F.col("o_totalprice").alias("amount"))
    args = {"kind": "csv", "root": f"{root}/in"}
    for status in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == status).drop("o_orderstatus").write.option("header", True).csv(f"{root}/in/{status}")
        start_committed(spark, spec, f"{root}/in", f"{root}/out", f"{root}/checkpoint", pattern="*.csv", **args).awaitTermination()
        if status == "O":
            again = published(spark, f"{root}/out", "ledger").where("rows_in > 0").select("path").limit(1)
            assert not commit_batch(spark, spec, again, f"{root}/out", "checkpoint/1", **args)
    ledger = published(spark, f"{root}/out", "ledger").select("run", "source_file", "status").distinct()
    clean = published(spark, f"{root}/out", "clean")
    return clean.join(ledger, ["run", "source_file"]).select("company", "article_sku", "sales_amount", "status")


@register("csv_wide", """
SELECT o_orderkey, CAST(o_custkey + 1 AS BIGINT) AS c1, CASE WHEN o_orderstatus = 'P' THEN 'no ' ELSE '' END || CAST(o_custkey + 15 AS VARCHAR) AS c15,
       CAST(CASE WHEN o_orderstatus <> 'O' THEN o_custkey + 40 END AS BIGINT) AS c40, CAST(o_totalprice AS DOUBLE) AS price FROM orders
""")
def q_csv_wide(spark, sf_dir):
    """Wide files of three layouts, read once for the summary and once for the result; a column that is a number in some files only
    stays text, one that a layout lacks is null."""
    from ..sources.csv_summary import read_csv_typed

    o = table(spark, sf_dir, "orders")
    root = scratch_path(spark, f"csv-wide-{uuid.uuid4().hex}")
    for status, cols in (("F", range(1, 41)), ("O", range(39, 0, -1)), ("P", [40, *range(1, 40)])):
        mark = lambda i: F.concat(F.lit("no "), (F.col("o_custkey") + i).cast("string")) if status == "P" and i == 15 else F.col("o_custkey") + i  # noqa: B023, E731
        part = o.where(F.col("o_orderstatus") == status).select(*[mark(i).alias(f"c{i}") for i in cols], "o_orderkey", F.col("o_totalprice").alias("price"))
        part.write.option("header", True).csv(f"{root}/{status}")
    return read_csv_typed(spark, root, JobSpec(source_type="csv")).select("o_orderkey", "c1", "c15", "c40", "price")


@register("preview_heads", """
SELECT 'company ' || o_orderstatus AS company, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS article_sku
FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 5
""")
def q_preview_heads(spark, sf_dir):
    """The first rows of every file, of which no more is read than holds them."""
    from ..sources.files import list_files
    from ..sources.heads import preview_files

    o = table(spark, sf_dir, "orders")
    root = scratch_path(spark, f"heads-{uuid.uuid4().hex}")
    for status in "FOP":  # one file each, in order
        part = o.where(F.col("o_orderstatus") == status).select("o_orderkey", F.col("o_custkey").alias("sku"), "o_orderpriority").orderBy("o_orderkey")
        part.coalesce(1).write.option("header", True).csv(f"{root}/company {status}")
    spec = JobSpec(source_type="csv", column_mappings={"o_orderkey": "order_id", "sku": "article_sku"}, columns=("o_orderkey", "sku"))
    rows = preview_files(list_files(spark, root), spec, 5)
    return rows.select(F.try_url_decode(F.regexp_extract("__path", "/([^/]+)/[^/]+$", 1)).alias("company"), "order_id", "article_sku")
