"""Synonym tables: canonical target fields and the header terms that point at them.

The tables are small configuration (tens of rows); they are DataFrames so that merging and
learning run as Spark joins, and they are handed to per-row helpers as plain lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# Shipped synonyms, target order and term order as configured.
DEFAULT_SYNONYMS = {
    "provider_id": ["provider", "vendor", "supplier", "source", "partner", "distributor", "department",
                    "channel", "account"],
    "article_sku": ["sku", "article", "item", "material", "product", "description", "desc", "part no",
                    "identifier", "owner", "product name", "product id", "item code"],
    "report_date": ["date", "period", "month", "time", "year", "invoice date", "doc date", "billing period",
                    "posting date", "calendar month"],
    "sales_qty": ["qty", "quantity", "units", "vol", "volume", "pcs", "pieces", "sold", "budget", "units sold"],
    "sales_amount": ["amount", "total", "value", "revenue", "sales", "net", "gross", "eur", "usd", "turnover",
                     "sales value", "net sales", "gross sales"],
    "order_id": ["order", "order_id", "id", "po number", "purchase order", "reference"],
    "region": ["region", "area", "location", "zone", "market"],
    "unit_price": ["unit_price", "price", "unit cost", "rate", "unit value"],
}

# Synonyms learned from saved mappings, as shipped.
LEARNED_SYNONYMS = {
    "provider_id": ["provider_id"],
    "unit_price": ["amount"],
    "product": ["product"],
    "quantity": ["quantity"],
    "amount": ["amount"],
}

SCHEMA = "target string, term string, origin string, target_pos int, term_pos int"


POSITIONS = 1 << 32  # positions of one table; those of the next come after


def synonym_frame(spark: SparkSession, synonyms: dict, origin: str = "base") -> DataFrame:
    rows = [(t, str(term), origin, i, j)
            for i, (t, terms) in enumerate(synonyms.items()) for j, term in enumerate(terms)]
    return spark.createDataFrame(rows, SCHEMA)


def merge_synonyms(base: DataFrame, extra: DataFrame) -> DataFrame:
    """M6: union of two synonym tables; a term already present for a target (case-blind) is
    dropped, the first spelling wins. Targets new to ``base`` come after its targets.

    Two small aggregates (first spelling per term, first position per target) and one join.
    """
    allrows = base.withColumn("__rank", F.lit(0)).unionByName(extra.withColumn("__rank", F.lit(1)))
    first = allrows.groupBy("target", F.lower("term").alias("__low")).agg(
        F.min_by(F.struct("term", "origin", "term_pos", "__rank"), F.struct("__rank", "term_pos")).alias("w"))
    tpos = allrows.groupBy("target").agg(F.min(F.struct("__rank", "target_pos")).alias("tp"))
    return first.join(tpos, "target").select(
        "target", "w.term", "w.origin",
        (F.col("tp.__rank").cast("long") * POSITIONS + F.col("tp.target_pos")).alias("target_pos"),
        (F.col("w.__rank").cast("long") * POSITIONS + F.col("w.term_pos")).alias("term_pos"))


def known_synonyms(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    """Shipped + learned synonyms merged once and checkpointed (a small table reused by many
    steps; the checkpoint cuts the repeated lineage)."""
    merged = merge_synonyms(synonym_frame(spark, DEFAULT_SYNONYMS),
                            synonym_frame(spark, LEARNED_SYNONYMS if extra is None else extra, "user"))
    return checkpointed(merged)


def as_dict(syn: DataFrame) -> dict:
    """Ordered ``{target: [terms]}`` of a synonym table, for use as a configuration: the caller knows that it is one."""
    out: dict = {}
    for r in syn.orderBy("target_pos", "term_pos").toLocalIterator():
        out.setdefault(r["target"], []).append(r["term"])
    return out


def learn_synonyms(mapping: DataFrame, known: DataFrame, header_col: str = "header",
                   target_col: str = "target", order_col: str | None = None) -> DataFrame:
    """M7: (header, target) pairs not yet known as a term of that target (case-blind).

    Blank headers or targets are skipped; a header text appearing twice is added once (first by
    ``order_col``). Returns ``(target, term)`` rows to append to the learned table.
    """
    m = mapping.select(F.trim(F.col(header_col).cast("string")).alias("term"),
                       F.trim(F.col(target_col).cast("string")).alias("target"),
                       (F.col(order_col) if order_col else F.lit(0)).alias("__o"))
    m = m.where((F.col("term") != "") & (F.col("target") != "") & F.col("term").isNotNull()
                & F.col("target").isNotNull())
    k = known.select("target", F.lower("term").alias("__low")).distinct()
    new = m.withColumn("__low", F.lower("term")).join(k, ["target", "__low"], "left_anti")
    first = new.groupBy("target", "__low").agg(F.min_by("term", F.struct("__o", "term")).alias("term"))
    return first.select("target", "term")
