"""N-gram Jaccard join with signature trees: documents linked by the similarity of their word shingles, and their classes.

The exact threshold prefix decides who has to meet: with the shingles of a set in order of their hashes, two sets of similarity t or more
share one of their first n - ceil(t n) + 1, and at least l of their first n - ceil(t n) + l. So

1. every document is reduced to the first n - ceil(t n) + l hashes, l = ``extra`` * n, and sets that are equal become one class;
2. hashes that two classes hold are found by an aggregation, and documents with fewer of them than any partner would share are left
   alone: they link with no other text. Few remain; a passage that many documents share does not keep them in;
3. the remaining documents get their whole sets and meet in blocks of a shared prefix hash. In each block a signature tree is
   joined with itself, pairs that pass are compared exactly, and one edge of a spanning forest is kept for every new connection.
   The first rounds take the first hashes alone and chunks of a block by themselves, which connects most copies. After that only blocks that
   still hold several components are gone through, for all prefix hashes: first with little more than sizes and places, so that
   a pair is considered in hardly any block but that of its first shared hash; then with signatures; whole sets follow
   for the few documents that pass.

Nothing is left out: every linked pair shares a block or is already connected. Crowded blocks are cut into chunks and pairs of chunks are units
of work of their own, so no block, however large, goes to one task, and a unit returns at most one edge or row per document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmaps
from .common import byte_batches, stored
from .components import components
from .shingles import mix, shingle_sets
from .signature_tree import bitmap, candidates


@dataclass(frozen=True)
class Join:
    words: int = 5
    num: int = 80  # similarity of num / den or more
    den: int = 100
    extra: float = 0.1  # l in shares of a set's size
    chunk: int = 1024  # documents of a chunk of a block
    chunk_bytes: int = 12 << 20  # of their whole sets
    rounds: int = 3  # over first hashes alone
    token_bits: int = 26  # filter of shared hashes: 8 MB, fixed
    id_bits: int = 23  # filter of remaining documents: 1 MB, fixed

    def prefix(self, n: int) -> int:
        """Hashes among which two linked sets share one."""
        return n - (self.num * n + self.den - 1) // self.den + 1

    def least(self, n):
        """l: how many of the first ``prefix(n) - 1 + l`` two linked sets share (no more than they share at all)."""
        return np.maximum(1, np.minimum(np.floor(self.extra * n), (self.num * n + self.den - 1) // self.den)).astype(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)), mix(s + np.uint64(0x14057B7EF767814F))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Join = Join()) -> DataFrame:
    """``id_col``, n_shingles and component_id (least id reachable by links, its own included) of every row.

    Words are runs of characters other than blank and the control characters 9 to 13, A-Z in lower case; a text with fewer words than
    a shingle has one shingle of them all. Texts that are null or without words have no shingles and link with nothing; rows without
    an id neither, and have no component. Texts with equal sets link. Ids name documents: rows that repeat an id are
    judged one by one and come back as often. Other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    profile = stored(_profile(docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "utf-8").alias("text")), kind, settings), "profile")
    classes = profile.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    classes = stored(classes, "classes")
    remaining = stored(_remaining(profile, classes, settings), "remaining")
    sets = stored(_sets(docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "utf-8").alias("text")), remaining, kind, settings), "sets")
    named = None
    for rank in range(settings.rounds + 1):
        joined = components(_round(sets, named, rank if rank < settings.rounds else None, kind, settings))  # writes the edges itself
        if named is None:
            named = joined.withColumnsRenamed({"node": "rep", "component": "comp"})
            continue
        # edges are between components: those named so far move on, others are documents of their own
        moved = named.join(joined, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("component", "comp").alias("comp"))
        fresh = joined.join(named, F.col("node") == F.col("rep"), "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
        named = stored(moved.unionByName(fresh), f"named{rank}")
    known = classes.join(named, "rep", "left").select("f1", "f2", "n", F.coalesce("comp", "rep").alias("component_id"))
    rows = profile.select("id", "n", "f1", "f2")
    out = rows.join(known, ["f1", "f2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _profile(docs: DataFrame, kind, s: Join) -> DataFrame:
    """Size, fingerprint and first hashes of every document's set."""
    def run(batches):
        for batch in byte_batches(batches, 2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), s.words)
            marks = [fingerprint(x) if len(x) else (0, 0) for x in sets]
            first = [x[: s.prefix(len(x)) - 1 + int(s.least(len(x)))].tobytes() if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()),
                                              pa.array([m[1] for m in marks], pa.int64()), pa.array(first, pa.binary())], names=["id", "n", "f1", "f2", "first"])

    return docs.mapInArrow(run, T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")), T.StructField("first", T.BinaryType())]))


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of sets, and the row of each."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint64), np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])


def _remaining(profile: DataFrame, classes: DataFrame, s: Join) -> DataFrame:
    """(rep, n, f1) of the classes with enough hashes that another class holds too."""
    def hold(batches):
        for batch in byte_batches(batches):
            token, row = _tokens(batch.column("first"))
            mark = np.asarray(batch.column("f1"))[row]
            order = np.lexsort((mark, token))
            token, mark = token[order], mark[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (mark[1:] != mark[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(token[new].view(np.int64)), pa.array(mark[new])], names=["token", "mark"])

    rows = profile.where("n > 0 and id is not null")
    held = rows.select("f1", "first").mapInArrow(hold, "token long, mark long")
    shared = held.groupBy("token").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b").select("token")
    shared = stored(shared, "shared")
    may = bitmaps.build(shared, "token", s.token_bits)

    def sift(batches):
        for batch in byte_batches(batches):
            token, row = _tokens(batch.column("first"))
            near = np.flatnonzero(bitmaps.holds(may, token))
            yield pa.RecordBatch.from_arrays([pa.array(token[near].view(np.int64)), batch.column("id").take(pa.array(row[near]))], names=["token", "id"])

    kind = profile.schema["id"]
    near = rows.select("id", "first").mapInArrow(sift, T.StructType([T.StructField("token", T.LongType()), kind]))
    counts = near.join(shared, "token", "left_semi").groupBy("id").agg(F.count("*").alias("m"))
    # the smallest set that a set of n may link with has ceil(t n) and posts that much fewer: what both are sure to post is its l
    whole = lambda n: F.floor((n * s.num + (s.den - 1)) / s.den)
    small = whole(F.col("n"))
    need = F.greatest(F.lit(1), F.least(F.floor(small * s.extra), whole(small)))
    return classes.join(counts, F.col("rep") == F.col("id")).where(F.col("m") >= need).select("rep", "n", "f1")


def _sets(docs: DataFrame, remaining: DataFrame, kind, s: Join) -> DataFrame:
    """(rep, n, tokens, bits) of the remaining documents. A bitmap of their ids keeps most other texts from being shuffled."""
    may = bitmaps.build(remaining.select(F.xxhash64("rep").alias("h")), "h", s.id_bits)

    def run(batches):
        for batch in byte_batches(batches, 2 << 20):
            batch = batch.filter(pa.array(bitmaps.holds(may, np.asarray(batch.column("h")).view(np.uint64))))
            if not batch.num_rows:
                continue
            sets = shingle_sets(batch.column("text").to_pylist(), s.words)
            marks = pa.array([fingerprint(x)[0] if len(x) else 0 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), marks, pa.array([x.tobytes() for x in sets], pa.binary()),
                                              pa.array([bitmap(x).tobytes() for x in sets], pa.binary())], names=["id", "mark", "tokens", "bits"])

    found = docs.where("id is not null").withColumn("h", F.xxhash64("id")).mapInArrow(run, T.StructType([
        T.StructField("id", kind), T.StructField("mark", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("bits", T.BinaryType())]))
    out = found.join(remaining, (F.col("id") == F.col("rep")) & (F.col("mark") == F.col("f1")))
    return out.dropDuplicates(["rep", "f1"]).select("rep", "n", "tokens", "bits")  # dealt as the join is


BEFORE = 8  # prefix hashes before the shared one that a document shows in a block


def _round(sets: DataFrame, named: DataFrame | None, rank: int | None, kind, s: Join) -> DataFrame:
    """Edges (a, b) between components of ``named`` (rep, comp; others are their own), from blocks of the hash at ``rank`` (None: of every prefix hash)."""
    rep, comp, token = T.StructField("rep", kind), T.StructField("comp", kind), T.StructField("token", T.LongType())

    def postings(only: np.ndarray | None):
        """Rows of blocks: the hash at ``rank``, or all prefix hashes (those in the bitmap ``only``) with their place and the hashes before it."""
        def run(batches):
            for batch in byte_batches(batches):
                rows, tokens, places, before = [], [], [], []
                for k, (n, first) in enumerate(zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist())):
                    mine = np.frombuffer(first, np.uint64, s.prefix(n))
                    at = np.array([rank] if rank < len(mine) else [], np.int64) if rank is not None else \
                        np.arange(len(mine)) if only is None else np.flatnonzero(bitmaps.holds(only, mine))
                    rows.append(np.full(len(at), k))
                    tokens.append(mine[at])
                    places.append(at)
                    if only is not None:
                        padded = np.concatenate([np.zeros(BEFORE, np.uint64), mine])
                        before += [padded[x: x + BEFORE].tobytes() for x in at.tolist()]
                take = pa.array(np.concatenate(rows))
                columns = [batch.column("rep").take(take), batch.column("n").take(take), pa.array(np.concatenate(tokens).view(np.int64)), batch.column("comp").take(take)]
                if only is not None:
                    columns += [pa.array(np.concatenate(places)), pa.array(before, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "token", "comp", "place", "before"][: len(columns)])

        fields = [rep, T.StructField("n", T.LongType()), token, comp]
        fields += [T.StructField("place", T.LongType()), T.StructField("before", T.BinaryType())] if only is not None else []
        return who.mapInArrow(run, T.StructType(fields))

    who = sets.select("rep", "n", "tokens")
    who = who.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")) if named is not None else who.withColumn("comp", F.col("rep"))
    light = postings(None)
    live = light.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("size")).where("lo <> hi")
    chunks = F.ceil(F.greatest(F.col("m") / s.chunk, F.col("size") * 8 / s.chunk_bytes)).cast("int")
    live = stored(live.select("token", chunks.alias("chunks")), "live")
    posted = light if rank is not None else postings(bitmaps.build(live, "token", s.token_bits))
    blocks = posted.join(live, "token").withColumn("part", F.pmod(F.xxhash64(F.lit(rank or 0), "rep"), F.col("chunks")).cast("int"))
    # a first round joins each chunk with itself and the next one deals the documents anew; the last has to join every two chunks
    blocks = blocks.withColumn("other", F.col("part") if rank is not None else F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    more = [] if rank is not None else ["n", "place", "before"]
    units = blocks.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "comp", *more)
    key, own = ["token", "i", "j"], ["token", "i", "j", "part", "rep", "comp"]
    unit = T.StructType([token, *(T.StructField(c, T.IntegerType()) for c in ("i", "j", "part")), rep, comp])

    def sides(part: np.ndarray, i: int, j: int):
        rows = np.arange(len(part))
        return (rows, None) if i == j else (rows[part == i], rows[part == j])

    def meet(batches):
        """The documents with a partner of another component for whom this block's hash may be the first they share: their sizes allow the
        threshold, so does what follows the hash in either set, and none of the hashes shown before it is shared. A linked
        pair passes in the block of its first shared hash; in later blocks it need not. Many units are gone through at once."""
        for table, bounds in _units(batches):
            n, place, comps, part = (np.asarray(table.column(c)) for c in ("n", "place", "comp", "part"))
            apart = np.asarray(table.column("i")) != np.asarray(table.column("j"))
            before = np.frombuffer(b"".join(table.column("before").to_pylist()), np.uint64).reshape(-1, BEFORE)
            near, rest = np.zeros(table.num_rows, bool), n - place
            later = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(table.num_rows) - 1  # rows after each in its unit
            upto = np.concatenate([[0], np.cumsum(later)])
            at = 0
            while at < table.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 20), "right")) - 1)
                a = np.repeat(np.arange(at, end), later[at:end])
                b = np.arange(len(a)) - np.repeat(upto[at:end] - upto[at], later[at:end]) + a + 1
                na, nb = n[a], n[b]
                may = (comps[a] != comps[b]) & (s.den * nb >= s.num * na) & (s.den * na >= s.num * nb)
                may &= ((s.num + s.den) * np.minimum(rest[a], rest[b]) >= s.num * (na + nb)) & (~apart[a] | (part[a] != part[b]))
                a, b = a[may], b[may]
                for k in range(0, len(a), 1 << 15):
                    p, q = a[k: k + (1 << 15)], b[k: k + (1 << 15)]
                    earlier = ((before[p][:, :, None] == before[q][:, None, :]) & (before[p][:, :, None] != 0)).any(axis=(1, 2))
                    near[p[~earlier]] = near[q[~earlier]] = True
                at = end
            yield from table.select(own).filter(pa.array(near)).to_batches()

    def sift(batches):
        """The documents that a pair between components may hold, by their signatures."""
        for table, bounds in _units(batches):
            bits = [np.frombuffer(b, np.uint64) for b in table.column("bits").to_pylist()]
            n, comps, part, i, j = (np.asarray(table.column(c)) for c in ("n", "comp", "part", "i", "j"))
            near = np.zeros(table.num_rows, bool)
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for a, b in candidates(bits[x:y], n[x:y], *sides(part[x:y], i[x], j[x]), s.num, s.den):
                    other = comps[x + a] != comps[x + b]
                    near[x + a[other]] = near[x + b[other]] = True
            yield from table.select(own).filter(pa.array(near)).to_batches()

    def settle(batches):
        """The components that a unit's linked pairs connect, each with the least of those it is connected to."""
        for table, bounds in _units(batches):
            tokens = [np.frombuffer(b, np.uint64) for b in table.column("tokens").to_pylist()]
            comps, part, i, j = (np.asarray(table.column(c)) for c in ("comp", "part", "i", "j"))
            found = [connect(tokens[x:y], comps[x:y], *sides(part[x:y], i[x], j[x])) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            same = table.schema.field("comp").type
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), same) for k in (0, 1)], names=["a", "b"])

    def connect(sets_, comp, left, right):
        sizes = np.array([len(x) for x in sets_])
        comps, lab = np.unique(comp, return_inverse=True)
        first = lab.copy()
        for a, b in candidates([bitmap(x) for x in sets_], sizes, left, right, s.num, s.den):
            while True:
                apart = lab[a] != lab[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    break
                tried = np.union1d(*(np.unique(lab[x], return_index=True)[1] for x in (a, b)))  # a pair of each component
                for k in tried:
                    x, y = sets_[a[k]], sets_[b[k]]
                    if lab[a[k]] == lab[b[k]]:
                        continue
                    same = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    if s.den * same >= s.num * (len(x) + len(y) - same):
                        one, other = sorted((lab[a[k]], lab[b[k]]))
                        lab[lab == other] = one
                a, b = np.delete(a, tried), np.delete(b, tried)
        ends = np.unique(np.stack([first, lab])[:, first != lab], axis=1)
        return comps[ends[0]], comps[ends[1]]

    def dealt(df):
        return df.repartition(*key).sortWithinPartitions(*key)

    if rank is None:
        units = stored(dealt(units).mapInArrow(meet, unit), "met")
        units = stored(dealt(units.join(sets.select("rep", "n", "bits"), "rep")).mapInArrow(sift, unit), "sifted")
    full = dealt(units.join(sets.select("rep", "tokens"), "rep"))
    return full.mapInArrow(settle, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _units(batches):
    """Tables of whole units and their bounds, from batches sorted by unit. A unit is bounded by the chunks."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in ("token", "i", "j"):
            x = np.asarray(table.column(c))
            new[1:] |= x[1:] != x[:-1]
        bounds = np.flatnonzero(new)
        if len(bounds) > 1:
            yield table.slice(0, bounds[-1]), bounds
            rest = table.slice(bounds[-1])
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])
