"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

QUERIES = {}
ORACLE = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset", "loss_tokens")


@register("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import compression

    docs = table(spark, sf_dir, "documents")
    model = compression.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = compression.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"), "evidence")


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    return language.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(text) + 2 * len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>')) + len(regexp_extract_all(text, '\\')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + escaped + 10 + 1) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@register("op8_chat_formatting", OP8_SQL)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


@register("op4_secret_scans")
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets
    from . import spans as S

    out = secrets.scan(table(spark, sf_dir, "documents"))
    kinds, base = [r.kind for r in secrets.RULES], [r.kind for r in secrets.BASE]
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return out.select("doc_id", *[S.count(F.col("spans"), k).alias(f"n_{k}") for k in base],
                      F.sha2(S.joined(own, base, "start"), 256).alias("base_sha256"),
                      S.joined(F.col("spans"), kinds, "start").alias("spans"))


@register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import personal as P
    from . import spans as S

    docs = table(spark, sf_dir, "documents")
    out = P.scan(docs, P.fit(docs))
    every = F.concat("base", "near")
    return out.select("doc_id", *[S.count(F.col("base"), k).alias(f"n_{k}") for k in P.KINDS],
                      F.sha2(S.joined(F.col("base"), P.KINDS, "kind"), 256).alias("base_sha256"),
                      S.joined(every, P.KINDS + P.NEAR, "kind").alias("spans"), F.size(every).cast("long").alias("n_spans"))


@register("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
u AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
k AS (SELECT a, count(*) AS n FROM u GROUP BY 1),
r AS (
  WITH RECURSIVE reach(node, other) AS (SELECT a, b FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.other = u.a)
  SELECT node, min(other) AS least FROM reach GROUP BY 1)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(m.vec_id, coalesce(r.least, m.vec_id)) AS component_id,
       m.vec_id <= coalesce(r.least, m.vec_id) AS kept
FROM embeddings m LEFT JOIN k ON k.a = m.vec_id LEFT JOIN r ON r.node = m.vec_id
"""


@register("op1_near_embeddings", OP1_SQL)
def op1_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_embeddings

    return near_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id) AS INT) AS rank,
       v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""


@register("op3_topk_search", OP3_SQL)
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import knn

    return knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  WITH RECURSIVE reach(node, other) AS (SELECT a, b FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.other = u.a)
  SELECT node, min(other) AS least FROM reach GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(r.least, n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.node = n.doc_id
"""


@register("op7_jaccard_join", OP7_SQL)
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.link(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(array_slice(b, p, p + 399)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS p FROM d)),
r AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, TRUE) AS fresh FROM r),
i AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY 1, 2),
k AS (
  SELECT doc_id, sum(z - a) AS gone, count(*) AS runs, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM s GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       CASE WHEN runs IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(
         [hex(array_slice(b, x[1], x[2] - 1)) FOR x IN list_zip(list_prepend(1, stops), list_append(starts, n + 1)) IF x[1] < x[2]], ''))) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@register("op12_suffix_dedup", OP12_SQL)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
k AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
p AS (
  SELECT *, list_slice(u, 1, least(h1 % (n + 1), h2 % (n + 1))) AS a,
         list_slice(u, least(h1 % (n + 1), h2 % (n + 1)) + 1, greatest(h1 % (n + 1), h2 % (n + 1))) AS b,
         list_slice(u, greatest(h1 % (n + 1), h2 % (n + 1)) + 1, n) AS c,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
j AS (SELECT *, array_to_string(a, '') AS pre, array_to_string(b, '') AS mid, array_to_string(c, '') AS suf FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM j
"""


@register("op11_fill_middle", OP11_SQL)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fill_middle

    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
