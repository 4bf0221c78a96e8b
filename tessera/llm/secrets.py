"""Secret scans over all versions of all paths with a ledger of scanned blobs.

A version's text is addressed by its sha256. The ledger has a row for each blob and the rule versions it was scanned
with, with the spans they found. A scan takes only the blobs that lack a rule version, each blob
once however many paths hold it, runs just the missing rules, appends to the ledger, and joins the
spans back to all paths. Editing a rule means raising its version: then that rule alone is run again.

DataFrame functions only. Blobs are told apart before texts move: the texts' aggregation by blob is combined
map-side, and the joins carry blob and spans, not texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import spans as S
from .common import stored


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    group: int | None = None  # the part that ``least`` measures (None: the match)
    least: int = 0  # shorter ones are dropped

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"

    def find(self, text):
        keep = (lambda m, g: F.length(g) >= self.least) if self.least else None
        return S.find(text, self.kind, self.pattern, keep, self.group)


#: The base rules, in the order of kinds, then those the ledger adds: key blocks and issued tokens with fixed prefixes.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a run of fewer would be dropped; runs are whole either way
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("issued", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{20,}+|AIza[A-Za-z0-9_-]{35})"),
)
RULES = BASE + ADDED
LEDGER = f"blob string, tags array<string>, spans {S.SPAN}"


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
         version_col: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, blob and spans of every row of ``docs`` (a row is one version of one path).

    ``ledger``: folder of the ledger, made if it is absent and appended to; None: a new one in the shared folder. Null texts count as
    empty and share the empty blob; equal texts share theirs. Repeated rows come back as often; other columns, whatever
    their names, are not read. An empty table scans nothing and gives no rows.
    """
    spark = docs.sparkSession
    new = ledger is None
    ledger = ledger or scratch_path(spark, f"llm-ledger-{uuid.uuid4().hex}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    tags = F.array(*[F.lit(r.tag) for r in rules])
    blobs = docs.select(text.alias("text")).groupBy(F.sha2("text", 256).alias("blob")).agg(F.first("text").alias("text"))
    if new or not _exists(spark, ledger):
        todo = blobs.withColumn("todo", tags)
    else:
        known = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("seen"))
        wanted = (docs.select(F.sha2(text, 256).alias("blob")).distinct().join(known, "blob", "left")
                  .select("blob", F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0))
        todo = (docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).join(wanted, "blob")
                .groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo")))
    found = F.concat(*[F.when(F.array_contains("todo", r.tag), r.find(F.col("text"))).otherwise(S.none()) for r in rules])
    todo.select("blob", F.col("todo").alias("tags"), found.alias("spans")).write.mode("append").parquet(ledger)
    return at_paths(docs, ledger, rules, text_col, keep)


def at_paths(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger's findings of the given rules at every row of ``docs``. Only blobs with findings are joined."""
    rows = docs.select(*[F.col(c) for c in keep], F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__blob"))
    tag = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.tag)])  # a ledger row's spans are of its own rule versions
    own = F.filter("spans", lambda s: F.coalesce(F.array_contains("tags", tag[s["kind"]]), F.lit(False)))
    hits = (docs.sparkSession.read.schema(LEDGER).parquet(ledger).select("blob", F.explode(own).alias("own"))
            .groupBy("blob").agg(F.collect_set("own").alias("__spans")))
    hits = stored(hits, "findings")  # as a table: Spark can then split the paths of a blob that many of them hold
    return (rows.join(hits, rows["__blob"] == hits["blob"], "left")
            .select(*[F.col(c) for c in keep], F.col("__blob").alias("blob"), F.coalesce("__spans", S.none()).alias("spans")))


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
