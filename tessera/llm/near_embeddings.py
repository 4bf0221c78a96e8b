"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of cosine >= t differ by a squared distance of at most 2 - 2t. They are rotated and split into blocks of few
dimensions; if every block got a share of that budget in proportion to its dimensions, at least one block of a pair
within the whole budget is within its own. So for each block the vectors are range-joined in that
block alone, on a grid over its first dimensions, and pairs within the block's budget are checked exactly. A pair that is within
budget in several blocks counts in the first of them, which either side can tell from the two
vectors, so nothing is compared across blocks.

Rotated coordinates are rounded to whole steps of 2**-14 and all block distances are whole numbers: every
task comes to the same verdict about a pair. The rounding is allowed for in the budgets, and the cosine itself
is computed from the given vectors in double precision.

The range join carries a block's coordinates only; whole vectors follow for the few rows with a partner within budget.

Equal vectors are first collapsed to a class. Crowded grid cells are cut into chunks of ``chunk`` vectors, and pairs of chunks are
separate units of work, so a cell that holds a third of all vectors is spread over many tasks; only one row
per vector and unit leaves them: its number of links and one edge of the unit's spanning forest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, stored
from .components import components

STEP = 1 << 14  # steps of the rounded coordinates in 1


@dataclass(frozen=True)
class Grid:
    """Shape of the join: dimensions of a block, those of them with a grid, its width in radii, vectors of a chunk."""

    block: int = 8
    dims: int = 3
    width: float = 4.0
    chunk: int = 1024
    seed: int = 20


class Blocks:
    """Rotation, blocks and cells for vectors of ``dim`` dimensions."""

    def __init__(self, dim: int, cosine: float, grid: Grid):
        self.dim, self.grid, self.cosine = dim, grid, cosine
        q, _ = np.linalg.qr(np.random.default_rng(grid.seed).standard_normal((dim, dim)))
        self.rotation = q
        self.cuts = [(at, min(dim, at + grid.block)) for at in range(0, dim, grid.block)]
        # a block's share of 2 - 2t; each of two roundings moves a coordinate by half a step at most
        whole = max(0.0, 2 - 2 * cosine)
        self.radius = [np.sqrt(whole * (b - a) / dim) * STEP * (1 + 1e-9) + np.sqrt(b - a) + 1 for a, b in self.cuts]
        self.budget = [r * r for r in self.radius]

    def rounded(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.rint(unit @ self.rotation * STEP).astype("<i2")  # of a unit vector, at most STEP

    def cells(self, q: np.ndarray, k: int):
        """(row, cell, home) of all cells of block ``k`` that the rows ``q`` enter: their own, and those cells of a higher number that
        lie within the block's radius."""
        a, b = self.cuts[k]
        dims, side = min(self.grid.dims, b - a), self.grid.width * self.radius[k]
        low = q[:, a: a + dims] + 2.0 * STEP
        span = int(np.ceil(4.0 * STEP / side)) + 2
        place = span ** np.arange(dims - 1, -1, -1)
        home = np.floor(low / side).astype(np.int64)
        number = home @ place
        rows, cells = [np.arange(len(q))], [number]
        for move in np.ndindex(*[3] * dims):
            move = np.array(move) - 1
            if not move.any():
                continue
            near = np.ones(len(q), bool)
            for d in range(dims):
                if move[d] < 0:
                    near &= low[:, d] - home[:, d] * side <= self.radius[k]
                elif move[d] > 0:
                    near &= (home[:, d] + 1) * side - low[:, d] <= self.radius[k]
            other = (home + move) @ place
            near &= other > number
            if near.any():
                rows.append(np.flatnonzero(near))
                cells.append(other[near])
        own = np.zeros(sum(map(len, rows)), bool)
        own[: len(q)] = True
        return np.concatenate(rows), np.concatenate(cells), own


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least connected row of each of ``n`` rows under the links i-j."""
    lab = np.arange(n)
    while True:
        least = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], least)
        np.minimum.at(new, lab[j], least)
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str | None = "label", grid: Grid = Grid()) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, n_links (other rows within ``cosine`` and of an equal label), component_id (least id
    reachable by links, its own included) and kept (its id is that).

    Vectors that are null, empty or zero or hold null or non-finite components, and rows whose label is null (with a ``label_col``) or
    whose id is null, link with nothing. A shorter vector counts as filled up with zeros. Repeated rows are vectors of
    their own, and link. Other columns are not read; an empty table gives no rows.
    """
    label = F.xxhash64(F.col(label_col)) if label_col else F.lit(0).cast("long")
    named = F.col(label_col).isNotNull() if label_col else F.lit(True)
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    base = vectors.select(F.col(id_col).alias("id"), (label if not label_col else F.col(label_col)).alias("label"), named.alias("named"), x.alias("x"))
    good = F.coalesce(F.col("named") & F.col("id").isNotNull() & ~F.exists("x", odd) & F.exists("x", lambda v: v != 0), F.lit(False))
    base = base.withColumn("good", good)
    key = [F.when(F.col("good"), F.xxhash64(F.lit(s), "x")).alias(f"h{s}") for s in (1, 2)]
    valid = base.where("good").select("id", "label", "x", *key)
    classes = stored(valid.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x")), "classes")
    dim = classes.agg(F.max(F.size("x"))).first()[0]
    result = vectors.select(F.col(id_col).alias("id"))
    if dim is None:
        links = components_ = None
    else:
        links = stored(_links(classes, Blocks(dim, cosine, grid), isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)), "links")
        components_ = components(links.where("peer <> rep"), "rep", "peer").withColumnsRenamed({"node": "rep", "component": "component_id"})
        links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    if links is None:
        return result.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    known = classes.select("label", "h1", "h2", "rep", "n").join(links, "rep", "left").join(components_, "rep", "left")
    known = known.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("component_id", "rep").alias("component_id"))
    out = base.select("id", "label", *key).join(known, ["label", "h1", "h2"], "left")
    first = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"),
                      F.coalesce(F.col("id") == first, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, blocks: Blocks, single: bool) -> DataFrame:
    """(rep, peer, links): for each class and unit of work the rows it links with there, and the least class of its component there."""
    grid, dim = blocks.grid, blocks.dim
    kind = classes.schema["rep"].dataType
    given = "<f4" if single else "<f8"

    def prepare(batches):
        """Rounded coordinates, made once: all that follows reads the same numbers."""
        for batch in byte_batches(batches):
            x = np.zeros((batch.num_rows, dim))
            lists = batch.column("x")
            inside = np.arange(dim)[None, :] < np.asarray(lists.value_lengths())[:, None]
            x[inside] = lists.flatten().to_numpy(zero_copy_only=False)
            q = blocks.rounded(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("c"), batch.column("g"), batch.column("n"), pa.array([v.tobytes() for v in q], pa.binary()),
                 pa.array([v.tobytes() for v in x.astype(given)], pa.binary())], names=["rep", "c", "g", "n", "q", "x"])

    # rep and c, a hash of the vector, name a class also where rows share an id
    rows = stored(classes.select("rep", F.col("h1").alias("c"), F.xxhash64("label").alias("g"), "n", "x").mapInArrow(
        prepare, f"rep {kind.simpleString()}, c long, g long, n long, q binary, x binary"), "rotated")

    def matrix(column, dtype):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), dim)

    def count(batches):
        """Vectors in each cell that a batch enters, summed in the batch."""
        for batch in byte_batches(batches):
            q, groups = matrix(batch.column("q"), "<i2"), np.asarray(batch.column("g"))
            for k in range(len(blocks.cuts)):
                at, cells, _ = blocks.cells(q, k)
                found, n = np.unique(np.stack([groups[at], cells]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(np.full(len(n), k)), pa.array(found[1]), pa.array(n)],
                                                 names=["g", "k", "cell", "m"])

    def enter(batches):
        """A row for every cell that a vector enters, with its coordinates of that block."""
        for batch in byte_batches(batches, 1 << 20):
            q, groups = matrix(batch.column("q"), "<i2"), np.asarray(batch.column("g"))
            for k, (a, b) in enumerate(blocks.cuts):
                at, cells, own = blocks.cells(q, k)
                take = pa.array(at)
                mine = pa.array([v.tobytes() for v in q[:, a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups[at]), pa.array(np.full(len(at), k)), pa.array(cells), batch.column("rep").take(take), batch.column("c").take(take),
                     pa.array(own), mine.take(take)], names=["g", "k", "cell", "rep", "c", "own", "b"])

    keys = "g long, k long, cell long"
    crowds = rows.mapInArrow(count, f"{keys}, m long").groupBy("g", "k", "cell").agg(F.sum("m").alias("m")).where("m > 1")
    crowds = crowds.select("g", "k", "cell", F.ceil(F.col("m") / grid.chunk).cast("int").alias("chunks"))
    entered = rows.mapInArrow(enter, f"{keys}, rep {kind.simpleString()}, c long, own boolean, b binary")
    entered = entered.join(crowds, ["g", "k", "cell"])  # a vector alone in a cell meets nobody there
    part = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    entered = entered.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    entered = entered.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "chunks")
    schema = T.StructType([T.StructField("rep", kind), T.StructField("peer", kind),
                           T.StructField("links", T.LongType())])

    key = ["g", "k", "cell", "i", "j"]

    def pairs(mine, own, part, i, j, budget):
        """Row pairs of a unit within the block's budget, in slabs: one side at home, two at home once, and of different parts if the
        unit joins two."""
        size = (mine * mine).sum(axis=1)
        homes = np.flatnonzero(own)
        for at in range(0, len(homes), 256):
            h = homes[at: at + 256]
            near = size[h][:, None] + size[None, :] - 2 * (mine[h] @ mine.T) <= budget
            near &= ~own[None, :] | (np.arange(len(own))[None, :] > h[:, None])
            if i != j:
                near &= part[h][:, None] != part[None, :]
            u, v = np.nonzero(near)
            yield h[u], v

    def head(table):
        k, i, j = (table.column(c)[0].as_py() for c in ("k", "i", "j"))
        return k, i, j, *(np.asarray(table.column(c)) for c in ("own", "part"))

    def meet(table: pa.Table) -> pa.Table:
        """The rows with a partner within the block's budget; only they are joined with their vectors."""
        k, i, j, own, part = head(table)
        mine = np.frombuffer(b"".join(table.column("b").to_pylist()), "<i2").reshape(table.num_rows, -1).astype(np.float64)
        near = np.zeros(table.num_rows, bool)
        for u, v in pairs(mine, own, part, i, j, blocks.budget[k]):
            near[u] = near[v] = True
        return table.select([*key, "part", "rep", "c", "own"]).filter(pa.array(near))

    def unit(table: pa.Table) -> pa.Table:
        k, i, j, own, part = head(table)
        x, q = matrix(table.column("x"), given).astype(np.float64), matrix(table.column("q"), "<i2").astype(np.float64)
        n = np.asarray(table.column("n"))
        norm = np.sqrt((x * x).sum(axis=1))
        a, b = blocks.cuts[k]
        found = []
        for u, v in pairs(q[:, a:b], own, part, i, j, blocks.budget[k]):
            for s in range(0, len(u), 65536):
                p, r = u[s: s + 65536], v[s: s + 65536]
                for e in range(k):  # within budget in an earlier block: counted there
                    c, d = blocks.cuts[e]
                    gap = q[p, c:d] - q[r, c:d]
                    later = (gap * gap).sum(axis=1) > blocks.budget[e]
                    p, r = p[later], r[later]
                close = np.einsum("ij,ij->i", x[p], x[r]) / (norm[p] * norm[r]) >= blocks.cosine
                found.append((p[close], r[close]))
        p, r = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        links = np.bincount(p, weights=n[r], minlength=len(q)) + np.bincount(r, weights=n[p], minlength=len(q))
        ids = np.asarray(table.column("rep"))
        order = np.argsort(ids, kind="stable")  # rows by id, so that the least row is the least id
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        least = ids[order][roots(len(q), place[p], place[r])][place]
        has = links > 0
        return pa.table({"rep": pa.array(ids[has]), "peer": pa.array(least[has]), "links": pa.array(links[has].astype(np.int64))})

    met = T.StructType([*(T.StructField(c, T.LongType()) for c in ("g", "k", "cell")), *(T.StructField(c, T.IntegerType()) for c in ("i", "j", "part")),
                        T.StructField("rep", kind), T.StructField("c", T.LongType()), T.StructField("own", T.BooleanType())])
    near = stored(entered.groupBy(*key).applyInArrow(meet, met), "met")
    return near.join(rows.select("rep", "c", "n", "q", "x"), ["rep", "c"]).groupBy(*key).applyInArrow(unit, schema)
