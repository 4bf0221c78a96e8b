"""Hot keys: one key holding a third of all rows, checked for results and for map-side combining."""

import contextlib
import io

from pyspark.sql import functions as F

from tessera.operators.aggregate import group_sum
from tessera.operators.discover import header_row_guess
from tessera.operators.lineage import FILE, ORD
from tessera.operators.order import dedupe_first

SF = "/root/testdata/sf0.01"


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _hot_events(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    # a third of all rows on one user
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))


def test_dedupe_hot_key_exact_and_combined(spark):
    ev = _hot_events(spark).withColumn(ORD, F.struct("ts", "event_id"))
    out = dedupe_first(ev, ["user_id"]).drop(ORD)
    got = {r["user_id"]: r["event_id"] for r in out.collect()}
    pdf = ev.drop(ORD).toPandas().sort_values(["ts", "event_id"])
    want = pdf.drop_duplicates("user_id", keep="first").set_index("user_id")["event_id"].to_dict()
    assert got == want
    plan = _plan(out)
    # min_by is combined per map task before the exchange: the hot key ships one row per task
    assert "partial_min_by" in plan and "Exchange" in plan


def test_group_sum_hot_key(spark):
    ev = _hot_events(spark)
    out = group_sum(ev.select("user_id", "value"), ["user_id"], per_file=False)
    got = {r["user_id"]: round(r["value"], 6) for r in out.collect()}
    pdf = ev.select("user_id", "value").toPandas()
    want = {k: round(v, 6) for k, v in pdf.groupby("user_id")["value"].sum().items()}
    assert got == want
    assert "partial_sum" in _plan(out)


def test_header_guess_hot_file(spark):
    """Every data row of one big file is text-heavy; the guess stays exact and the per-row stats
    are reduced per (file, fill) before meeting the width."""
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    cells = li.select(
        F.when(F.col("l_returnflag") == "R", F.lit("hot")).otherwise(F.col("l_returnflag")).alias(FILE),
        F.col("l_orderkey").alias("row"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("col"), F.col("l_returnflag").alias("value"), F.lit("text").alias("kind")),
            F.struct(F.lit(1).alias("col"), F.col("l_linestatus").alias("value"), F.lit("text").alias("kind")),
            F.struct(F.lit(2).alias("col"), F.col("l_quantity").cast("string").alias("value"),
                     F.lit("number").alias("kind")))).alias("c")).select(FILE, "row", "c.*")
    got = {r[FILE]: r["header_row"] for r in header_row_guess(cells).collect()}
    # rows have 2 text cells of 3 filled: text share 0.67 -> no row qualifies -> 0 everywhere
    assert set(got.values()) == {0}
    text_rows = cells.where("col < 2")   # now every row is all text and fills 2 of 2 columns
    got2 = {r[FILE]: r["header_row"] for r in header_row_guess(text_rows).collect()}
    mins = {r[FILE]: r["m"] for r in cells.groupBy(FILE).agg(F.min("row").alias("m")).collect()}
    assert got2 == mins
