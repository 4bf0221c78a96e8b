"""A training corpus from raw documents: each stage calls one operator, and its decisions take effect on the rows.

A stage takes the session, the documents the stage before kept, and the folder of the tables. All but the last return documents again
(doc_id, text, lang, source, n_chars); the last returns the pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import compression, jaccard_join, mixing, packing, secrets
from tessera.llm import spans as S
from tessera.llm.common import held_out, stored, table
from tessera.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score is below 0.7 go. Learnt from the labels that are not held out."""
    docs = docs.select(COLUMNS)
    model = compression.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return compression.keep_good(docs, model)


def row_hash(seed: int):
    """64 bits of all columns of a row."""
    return F.xxhash64(F.lit(seed), *COLUMNS, *[F.col(c).isNull() for c in COLUMNS])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by the similarity of their shingles, the one with the least id stays, once. Rows are told apart by hashes of all
    their columns, so rows that repeat an id with unlike texts are judged one by one and equal rows stay once. Where two unlike rows share a
    64-bit hash, which happens among billions, those rows go by a second one. Rows without an id are never linked and stay."""
    docs = docs.select(COLUMNS)
    rows = docs.where("doc_id is not null").withColumns({"first_key": row_hash(1), "second_key": row_hash(2)})
    seconds = rows.groupBy("first_key").agg(F.min("second_key").alias("a"), F.max("second_key").alias("b"))
    shared = stored(seconds.where("a <> b").select("first_key", F.lit(True).alias("shared")), "shared-keys")
    rows = rows.join(shared, "first_key", "left")
    rows = rows.withColumn("row_key", F.when(F.col("shared"), F.col("second_key")).otherwise(F.col("first_key"))).select(*COLUMNS, "row_key")
    linked = jaccard_join.link(rows, id_col="row_key").select("row_key", "component_id").distinct()
    first = rows.select("row_key", "doc_id").join(linked, "row_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("least"))
    kept = rows.join(first.select("least.row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(COLUMNS)
    return kept.unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind in angle brackets; n_chars is then the new length. Null texts stay null."""
    found = secrets.scan(docs, keep=tuple(COLUMNS))
    changed = F.size("spans") > 0
    text = S.redacted(F.col("text"), F.col("spans"), lambda kind: F.concat(F.lit("<"), kind, F.lit(">")))
    out = found.select("doc_id", F.when(changed, text).otherwise(F.col("text")).alias("text"), "lang", "source", "n_chars", changed.alias("changed"))
    return out.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents it takes no copy of go."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows (copies are packed one by one) in sequences of 4096 tokens."""
    out = packing.pack(docs, vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("secret scans", redact_secrets),
          ("mixing sources", mix_sources), ("packing", pack)]

#: Compression and tokenisation have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
