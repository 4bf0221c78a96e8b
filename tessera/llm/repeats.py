"""Removal of long byte strings that also begin elsewhere, by suffix sorting (see ``suffixes``) of those parts of texts that can repeat.

A window is ``length`` bytes in a row. Every window holds one least gram (a shorter run of bytes, by a hash of it, the
first of equals), and equal windows hold it at the same place. Consecutive windows with the same least gram make a unit, keyed by that
gram: windows of different keys are never equal, so each key can be solved alone, wherever its texts lie. Equal units are counted
before anything else moves; keys with a single unit are done. The bytes of the others are fetched, one copy of each
different unit, and sorted by suffixes, many keys at a time; neighbours with a common prefix of ``length`` bytes repeat.

A key with more than ``many`` different units (a passage in countless surroundings) is not sorted in one task: its units are cut into
units of ``blocks[0]`` windows, keyed by all bytes their windows share, then of ``blocks[1]`` and so on. The last are single windows, whose key is
the window, so that equal ones have become one counted unit. Nothing is left out on the way.

Grams, units and rows are told apart by 64-bit hashes in pairs (128 bits); bytes are compared within a key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import byte_batches
from .suffixes import Suffixes

OWNER = ["o1", "o2"]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UNITS = "o1 long, o2 long, key long, ctx long, start long, length int, at int, n long"
RUNS = "array<struct<s:long,e:long>>"


@dataclass(frozen=True)
class Cut:
    length: int = 400  # bytes of a window
    gram: int = 100  # bytes of a gram
    blocks: tuple[int, ...] = (16, 1)  # windows of the units that a crowded key is cut into; the last is 1
    many: int = 1000  # different units of a key that one task sorts at most
    piece: int = 1 << 20  # bytes that are looked through at a time
    sort_bytes: int = 1 << 19  # bytes of units that are sorted at a time, or one key's


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back. The shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


class Grams:
    """Rolling hashes of all grams of some bytes, and the least one of every window."""

    def __init__(self, cut: Cut):
        rng = np.random.default_rng(11)
        self.cut, self.count = cut, cut.length - cut.gram + 1  # grams of a window
        self.byte = rng.integers(1, 1 << 63, 256, np.uint64)
        self.place = np.arange(cut.piece + cut.length, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
        n = cut.piece + cut.length
        self.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))
        self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)))

    def least(self, raw: np.ndarray) -> np.ndarray:
        """Where the least gram of each window of ``raw`` begins: hashes of 40 bits, of equal ones the first."""
        gram, w = self.cut.gram, self.count
        total = np.cumsum(np.append(np.uint64(0), self.byte[raw] * self.up[:len(raw)]))
        m = len(raw) - gram + 1
        h = (total[gram:] - total[:m]) * self.down[:m]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = ((h ^ (h >> np.uint64(29))) & ~np.uint64((1 << 24) - 1)) | self.place[:m]
        blocks = np.append(h, np.full(-m % w, ~np.uint64(0))).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - w + 1
        return (np.minimum(behind[:windows], ahead[w - 1: w - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _units(cut: Cut):
    def make(batches):
        grams = Grams(cut)
        for batch in byte_batches(batches, cut.piece):
            body = batch.column("body")
            cuts = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, body.offset * 4).astype(np.int64)
            raw = np.frombuffer(body.buffers()[2], np.uint8, cuts[-1] - cuts[0], cuts[0])
            cuts -= cuts[0]
            begins = np.zeros(len(raw) + 1, np.int8)  # where a window of one text begins
            full = np.diff(cuts) >= cut.length
            np.add.at(begins, cuts[:-1][full], 1)
            np.add.at(begins, cuts[1:][full] - cut.length + 1, -1)
            begins = np.cumsum(begins[:-1], dtype=np.int8).astype(bool)
            for low in range(0, len(raw), cut.piece):
                part = raw[low: low + cut.piece + cut.length - 1]
                if len(part) < cut.length or not begins[low: low + cut.piece].any():
                    continue
                at = grams.least(part)
                ok = begins[low: low + len(at)]
                new = ok.copy()
                new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
                first = np.flatnonzero(new)
                gone = ok.copy()
                gone[:-1] &= ~ok[1:] | new[1:]
                last = np.flatnonzero(gone) + cut.length
                gram = at[first]
                view = memoryview(part)
                key = [xxhash.xxh3_64_intdigest(view[a: a + cut.gram]) for a in gram.tolist()]
                ctx = [xxhash.xxh3_64_intdigest(view[a:b], 1) for a, b in zip(first.tolist(), last.tolist())]
                row = np.searchsorted(cuts, first + low, "right") - 1
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("o1").take(take), batch.column("o2").take(take), pa.array(_signed(key)), pa.array(_signed(ctx)),
                     pa.array(first + low - cuts[row]), pa.array((last - first).astype(np.int32)),
                     pa.array((gram - first).astype(np.int32)), pa.array(np.ones(len(first), np.int64))],
                    ["o1", "o2", "key", "ctx", "start", "length", "at", "n"])
    return make


def _smaller(cut: Cut, block: int):
    """Units of ``block`` windows out of larger ones. Their key hashes the bytes that all windows of the block share, whether the unit
    holds all of them or not, so that equal windows keep equal keys."""
    def make(batches):
        for batch in byte_batches(batches, cut.piece):
            out = []
            for r in batch.to_pylist():
                body, at = r["body"], r["at"]
                windows = len(body) - cut.length + 1
                seed = (r["key"] ^ r["key"] >> 32) & 0xFFFFFFFF
                for b in range((at - windows + 1) // block, at // block + 1):
                    late, early = at - b * block, at - b * block - block + 1  # the last and the first window of the block
                    low, high = max(0, early), min(windows - 1, late)
                    core = body[late: early + cut.length]
                    key = xxhash.xxh3_64_intdigest(core, seed * 31 + b + block)
                    ctx = xxhash.xxh3_64_intdigest(body[low: high + cut.length], 1)
                    out.append((r["key"], r["ctx"], key, ctx, low, high - low + cut.length, at - low, r["n"]))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(_signed(cols[2])), pa.array(_signed(cols[3])),
                     pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int32()), pa.array(cols[7], pa.int64())],
                    ["o1", "o2", "key", "ctx", "start", "length", "at", "n"])
    return make


def _sort(cut: Cut):
    """Runs of windows of each unit that repeat; rows come in order of their keys, and whole keys are sorted together."""
    def solve(rows):
        units = Suffixes([r[3] for r in rows], cut.length)
        marks = np.zeros(len(units.data) + 1, np.int8)
        marks[units.repeated()] = 1
        out = []
        for (key, ctx, n, body), begin in zip(rows, units.begin.tolist()):
            windows = len(body) - cut.length + 1
            hit = np.ones(windows, np.int8) if n > 1 else marks[begin: begin + windows]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
            if len(edge):
                out.append((key, ctx, [{"s": int(a), "e": int(b)} for a, b in zip(edge[::2], edge[1::2])]))
        return pa.RecordBatch.from_pylist([dict(zip(("key", "ctx", "runs"), x)) for x in out], _RUN_SCHEMA) if out else None

    def make(batches):
        rows, size, last = [], 0, (None, None)
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "n", "body"))):
                if r[:2] == last:
                    continue  # the unit of another copy of its owner
                if r[0] != last[0] and size >= cut.sort_bytes:
                    if (done := solve(rows)) is not None:
                        yield done
                    rows, size = [], 0
                last = r[:2]
                rows.append(r)
                size += len(r[3])
        if rows and (done := solve(rows)) is not None:
            yield done
    return make


_RUN_SCHEMA = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("runs", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])


def _repeated(units: DataFrame, bodies: DataFrame, cut: Cut, blocks: tuple[int, ...]) -> DataFrame:
    """key, ctx and the runs of repeated windows (offsets in the unit, end exclusive) of all units with any. ``bodies``: the owners' bytes."""
    one = [F.first(c).alias(c) for c in (*OWNER, "start", "length", "at")]  # any of the equal units
    groups = _kept(units.groupBy("key", "ctx").agg(F.sum("n").alias("n"), *one), "units")
    keys = groups.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("all")).where("all > 1")
    crowded = (F.col("different") > cut.many) if blocks else F.lit(False)
    live = groups.join(keys.select("key", crowded.alias("crowded")), "key")
    body = F.expr("substring(body, cast(start + 1 as int), length)")
    found = _kept(live.join(bodies, OWNER).select("key", "ctx", "n", "at", "crowded", body.alias("body")), "bytes")
    small = found.where("not crowded").select("key", "ctx", "n", "body")
    runs = small.repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(_sort(cut), f"key long, ctx long, runs {RUNS}")
    if not blocks or not found.where("crowded").limit(1).count():
        return runs
    crowd = found.where("crowded")
    parts = _kept(crowd.select("key", "ctx", "n", "at", "body").dropDuplicates(["key", "ctx"]).mapInArrow(_smaller(cut, blocks[0]), UNITS), "parts")
    deeper = _repeated(parts, crowd.select(F.col("key").alias("o1"), F.col("ctx").alias("o2"), "body"), cut, blocks[1:])
    return runs.unionByName(_at_owners(parts, deeper).select(F.col("o1").alias("key"), F.col("o2").alias("ctx"), "runs"))


def _at_owners(units: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs of units as offsets in what they were cut from. An owner's equal units (rows that repeat) count once."""
    moved = F.transform("runs", lambda r: F.struct((r["s"] + F.col("start")).alias("s"), (r["e"] + F.col("start")).alias("e")))
    return (units.select(*OWNER, "key", "ctx", "start").join(runs, ["key", "ctx"])
            .groupBy(*OWNER).agg(F.flatten(F.collect_set(moved)).alias("runs")))


def _remove(length: int):
    def make(batches):
        for batch in byte_batches(batches, 8 << 20):
            kept, removed, spans = [], [], []
            for body, runs in zip(batch.column("body"), batch.column("runs").to_pylist()):
                raw = body.as_py()
                out, at, gone, count = [], 0, 0, 0
                for s, e in sorted((r["s"], r["e"] + length - 1) for r in runs or ()):
                    if s > at or not count:
                        out.append(raw[at:s])
                        count += 1
                        gone += e - s
                    else:
                        gone += max(0, e - at)
                    at = max(at, e)
                out.append(raw[at:])
                kept.append(b"".join(out))
                removed.append(gone)
                spans.append(count)
            names = [c for c in batch.schema.names if c not in ("body", "runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64())], [*names, "kept", "n_removed", "n_spans"])
    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: Cut = Cut()) -> DataFrame:
    """``id_col``, kept (the bytes that remain, which may break a character), n_removed (bytes) and n_spans (maximal removed
    runs) of every row: a byte goes if a string of ``cut.length`` bytes that covers it also begins anywhere else in the table.

    Strings lie within one text, are judged on the input and may overlap each other. Null texts count as empty; texts shorter than a window keep all.
    Rows that repeat are rows of their own, so long equal texts all go; ids may be null or repeat. Other columns, whatever
    their names, are not read; an empty table gives no rows. A very long text is looked through in pieces, but is one value of its row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("body"),
                       *[F.xxhash64(F.lit(s), F.col(id_col).cast("string"), text).alias(o) for s, o in enumerate(OWNER)])
    bodies = rows.select(*OWNER, "body").where(F.octet_length("body") >= cut.length)
    units = _kept(bodies.mapInArrow(_units(cut), UNITS), "grams")
    runs = _repeated(units, bodies, cut, cut.blocks)
    spans = _kept(_at_owners(units, runs), "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(spans, OWNER, "left").select("id", "body", "runs")
    out = joined.mapInArrow(_remove(cut.length), f"id {kind}, kept binary, n_removed long, n_spans long")
    return out.withColumnRenamed("id", id_col)
