import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import QUERIES, vocabulary
from tessera.llm.word_bpe import word_bpe

EXACT = Tokenizer.from_file(vocabulary())


def ids(text):
    return np.array(EXACT.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdefgh  .,'’!?stmdvrel0123456789\n\t-_#\"éÉßñÿ×÷"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_vocabulary_librarys(text):
    assert word_bpe(vocabulary()).ids(text) == ids(text).tobytes()


@pytest.mark.parametrize("text", ["It's the Dogs' 'll we'Re x'd''s", "a<|endoftext|>b", "...!!! ?.,", "İstanbul é ﬁ", "a b\x0bc\x1cd", "x" * 5000])
def test_ids_of_awkward_texts(text):
    assert word_bpe(vocabulary()).ids(text) == ids(text).tobytes()


def check(rows, texts, end=(2,)):
    """Every id of every row lies in exactly one piece, and sequences have no gaps. ``texts``: id -> list of its texts."""
    from collections import defaultdict
    whole = sorted((repr(k), b"".join(r.ids for r in g)) for k, g in _documents(rows))
    assert whole == sorted((repr(k), np.append(ids(t), np.array(end, "<u4")).astype("<u4").tobytes()) for k, ts in texts.items() for t in ts)
    by = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by[r.sequence_id].append(r)
    for g in by.values():
        at = 0
        for r in sorted(g, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    return {k: (sum(r.length for r in g), len(g), sum(r.loss_tokens for r in g)) for k, g in by.items()}


def _documents(rows):
    """Pieces put together by id; pieces of repeated rows follow each other in order of start."""
    from collections import defaultdict
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for k, g in by.items():
        while g:
            at, doc = 0, []
            total = min(r.doc_tokens for r in g)
            while at < total:
                r = next(r for r in g if r.start == at and r.doc_tokens == total)
                g.remove(r)
                doc.append(r)
                at += r.length
            yield k, doc


def test_awkward_documents(spark, documents):
    rows = packing.pack(documents, vocabulary()).collect()
    texts = {}
    for r in documents.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    sizes = check(rows, texts)
    assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n, _, _ in sizes.values())
    assert packing.pack(documents.limit(0), vocabulary()).count() == 0


def test_limits_hold_together(spark, table):
    from pyspark.sql import functions as F
    docs = table("documents").withColumn("loss", F.pmod(F.hash("doc_id"), F.lit(300)))
    lim = packing.Limits(tokens=1024, segments=4, loss=512)
    for cut in (True, False):
        rows = packing.pack(docs, vocabulary(), limits=lim, loss_col="loss", cut=cut).collect()
        sizes = check(rows, {r.doc_id: [r.text] for r in docs.select("doc_id", "text").collect()})
        assert max(s[0] for s in sizes.values()) <= 1024 and max(s[1] for s in sizes.values()) <= 4 and max(s[2] for s in sizes.values()) <= 512
        if not cut:  # only examples beyond a limit are cut
            own = {r.doc_id: r for r in docs.collect()}
            pieces = [r for r in rows if r.length < r.doc_tokens]
            assert all(r.doc_tokens > 1024 or own[r.doc_id].loss > 512 for r in pieces)


def test_query(spark, sf, table):
    rows = QUERIES["op5_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    total = 0
    for r in rows:
        own = np.append(ids(texts[r.doc_id]), 2).astype("<u4")
        assert len(own) == r.doc_tokens and zlib.crc32(own[r.start: r.start + r.length].tobytes()) == r.ids_crc32
        total += r.length
    assert total == sum(len(ids(t)) + 1 for t in texts.values())
