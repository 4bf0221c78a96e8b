import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from tessera.llm import compression, mixing
from tessera.llm.common import held_out
from test_jaccard import brute
from test_packing import ids
from test_secrets import base

FIELDS = P.COLUMNS


def rows(df):
    return sorted(df.select(FIELDS).collect(), key=repr)


def test_stages_one_by_one(spark, sf, table):
    docs = table("documents")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]
    scores = compression.score(docs, compression.fit(docs, table("labels").where(~held_out())))
    good = {r.doc_id for r in scores.where("score >= 0.7").collect()}
    one = P.quality(spark, docs, sf)
    assert one.columns == FIELDS and rows(one) == rows(docs.where(F.col("doc_id").isin(list(good)))) and 0 < len(good) < docs.count()

    two = P.near_copies(spark, one, sf)
    classes = brute([(r.doc_id, r.text) for r in one.collect()])[0]
    first = {int(i) for i, _, c in classes if i == c}
    assert two.columns == FIELDS and rows(two) == rows(one.where(F.col("doc_id").isin(list(first))))

    three = P.redact_secrets(spark, two, sf)
    before = {r.doc_id: r for r in two.collect()}
    assert three.columns == FIELDS and three.count() == len(before)
    for r in three.collect():
        found = base(before[r.doc_id].text)
        assert not base(r.text)
        assert (r == before[r.doc_id]) if not found else (r.text != before[r.doc_id].text and r.n_chars == len(r.text))
        outside = re.sub(r"<(assign|access|hex|pem|jwt|issued)>", "", r.text)
        assert len(outside) <= len(before[r.doc_id].text)

    four = P.mix_sources(spark, three, sf)
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    times = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == FIELDS and times == {k: n for k, n in copies.items() if n}

    five = P.pack(spark, four, sf).collect()
    assert sum(r.length for r in five) == sum(len(ids(r.text)) + 1 for r in four.collect())


def test_stages_with_awkward_documents(spark, documents, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = documents.select(FIELDS)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, documents, sf)
        assert (out.count() > 0 or name == "quality classifier") and (name == "packing" or out.columns == FIELDS), name
    kept = [r.doc_id for r in P.near_copies(spark, docs, sf).collect()]
    assert sorted(kept, key=repr) == sorted([1, 3, 4, 5, 6, None, 10, 11, 13], key=repr)


def test_near_copies_of_repeated_ids(spark, sf):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    docs = [(5, one), (5, two), (5, two), (3, one + " more"), (7, two + " more"), (8, three), (8, None), (8, ""), (9, three)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in P.near_copies(spark, df, sf).collect()), key=repr)
    assert kept == sorted([(3, one + " more"), (5, two), (8, three), (8, None), (8, "")], key=repr)


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


def test_rows_that_share_a_hash_are_not_lost(spark, documents, sf, monkeypatch):
    """With a first hash of two values every row shares it with unlike ones."""
    docs = documents.select(FIELDS)
    want = rows(P.near_copies(spark, docs, sf))
    real = P.row_hash
    monkeypatch.setattr(P, "row_hash", lambda seed: F.pmod(real(seed), F.lit(2)) if seed == 1 else real(seed))
    assert rows(P.near_copies(spark, docs, sf)) == want
