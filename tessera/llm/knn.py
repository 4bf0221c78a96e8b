"""Exact top-k search by inner product as a Voronoi kNN join.

The largest inner products are the smallest distances once every data vector gets one more coordinate that brings
it to the largest norm M, and every query a zero there: |q - x|^2 = |q|^2 + M^2 - 2 q.x. In that space a few pivots, taken
from the data, divide queries and data into Voronoi cells. Summaries of the cells (how far queries lie from each pivot, how far the
nearest data vectors lie from theirs) bound the distance within which each query group finds its k, and a data
vector goes to just those groups that it may be near enough to. Groups are cut into chunks of queries and of
data, solved one by one with whole numbers, and the few best of each chunk are merged.

Bounds are computed in double precision with a margin, scores exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, stored

SLACK = 1e-6  # relative margin of every bound


@dataclass(frozen=True)
class Cells:
    pivots: int = 16
    sample: int = 512  # vectors the pivots are chosen from
    data_chunk: int = 8192
    query_chunk: int = 1024


def choose(x: np.ndarray, count: int) -> np.ndarray:
    """Spread pivots: the first vector, then always the one furthest from those chosen."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def steps(vector_col: str, scale: float):
    """floor(scale * component) of each component as a long (beyond its range: the range's end); null for a vector that is null or
    holds null or non-finite components."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd, F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-9.2e18)), F.lit(9.2e18)))))


def search(vectors: DataFrame, queries, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
           cells: Cells = Cells()) -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score: for every row of ``vectors`` where ``queries`` (a condition) holds, the ``k`` rows of other
    ids with the highest inner product of floor(``scale`` * component); ties go to the smaller id, and where there are fewer, all.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part; a shorter vector counts as
    filled up with zeros. Repeated rows (same id and vector) count once; an id with several vectors is several candidates, and
    as a query gets the best over its vectors. Scores beyond a long stop at its ends. Other columns are not read; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    out = T.StructType([T.StructField("query_id", kind), T.StructField("vec", kind), T.StructField("score", T.LongType())])
    base = vectors.select(F.col(id_col).alias("id"), steps(vector_col, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    top = F.aggregate("v", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v.cast("double"))))
    norm = F.aggregate("v", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    seen = base.agg(F.max(F.size("v")).alias("dim"), F.max(top).alias("top"), F.max(norm).alias("norm")).first()
    dim = max(1, seen.dim or 1)
    narrow = (seen.top or 0) < 32768
    exact = (seen.top or 0) ** 2 * dim < 2 ** 53
    dtype, m2 = ("<i2" if narrow else "<i8"), float(seen.norm or 0.0)

    def encode(batches):
        for batch in byte_batches(batches):
            lists = batch.column("v")
            x = np.zeros((batch.num_rows, dim), dtype)
            x[np.arange(dim)[None, :] < np.asarray(lists.value_lengths())[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), batch.column("asks")], names=["id", "v", "asks"])

    data = stored(base.mapInArrow(encode, T.StructType([T.StructField("id", kind), T.StructField("v", T.BinaryType()), T.StructField("asks", T.BooleanType())])), "steps")

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), dim)

    sample = data.orderBy(F.xxhash64(F.lit(3), "id"), "id", "v").limit(cells.sample).collect()
    if not sample:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), F.col("vec").alias(id_col), "score")
    points = np.stack([np.frombuffer(bytes(r.v), dtype) for r in sample]).astype(np.float64)
    lift = lambda x: np.sqrt(np.maximum(0, m2 - (x * x).sum(axis=1)))
    pivots = choose(np.concatenate([points, lift(points)[:, None]], axis=1), cells.pivots)
    count = len(pivots)

    def distances(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        y = np.concatenate([x, extra[:, None]], axis=1)
        return np.sqrt(np.maximum(0, (y * y).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * y @ pivots.T))

    def of(batch, ask: bool):
        x = matrix(batch.column("v")).astype(np.float64)
        return distances(x, np.zeros(len(x)) if ask else lift(x))

    # summaries: of each query group its size and its range of distances from every pivot; of each data cell the k + 1 nearest to its pivot
    def summarise(batches):
        for batch in byte_batches(batches):
            d = of(batch, False)
            cell, ids = d.argmin(axis=1), batch.column("id").to_pylist()
            for c in np.unique(cell):
                mine = np.flatnonzero(cell == c)
                best = {}
                for r in mine[np.argsort(d[mine, c], kind="stable")]:
                    best.setdefault(ids[r], float(d[r, c]))
                    if len(best) > k:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([int(c)] * len(best)), pa.array(list(best), batch.schema.field("id").type), pa.array(list(best.values()))],
                                                 names=["c", "id", "d"])

    def survey(batches):
        for batch in byte_batches(batches):
            d = of(batch, True)
            group = d.argmin(axis=1)
            for g in np.unique(group):
                mine = d[group == g]
                yield pa.RecordBatch.from_arrays([pa.array([int(g)]), pa.array([len(mine)]), pa.array([mine.min(axis=0).tolist()]), pa.array([mine.max(axis=0).tolist()])],
                                                 names=["g", "n", "low", "high"])

    asks = data.where("asks")
    near = data.mapInArrow(summarise, T.StructType([T.StructField("c", T.LongType()), T.StructField("id", kind), T.StructField("d", T.DoubleType())]))
    near = near.groupBy("c", "id").agg(F.min("d").alias("d"))
    nth = F.row_number().over(Window.partitionBy("c").orderBy("d", "id"))
    near = near.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("c", "d").collect()
    spread = asks.mapInArrow(survey, "g long, n long, low array<double>, high array<double>").groupBy("g").agg(
        F.sum("n").alias("n"), *[F.min(F.col("low")[j]).alias(f"low{j}") for j in range(count)], *[F.max(F.col("high")[j]).alias(f"high{j}") for j in range(count)]).collect()
    low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
    asked = np.zeros(count, np.int64)
    for r in spread:
        asked[r.g] = r.n
        low[r.g] = [r[f"low{j}"] for j in range(count)]
        high[r.g] = [r[f"high{j}"] for j in range(count)]
    # of group g, any query is within high[g, c] of pivot c, and so within high[g, c] + d of a data vector that lies d from it
    limit = np.full(count, np.inf)
    groups = np.flatnonzero(asked)
    for g in groups:
        bounds = np.sort(np.array([high[g, r.c] + r.d for r in near]))
        if len(bounds) > k:  # one of them may be the query's own row
            limit[g] = bounds[k] * (1 + SLACK) + SLACK

    def needed(d: np.ndarray) -> np.ndarray:
        """Rows x groups: the triangle inequality at every pivot leaves the row within the group's limit."""
        out = np.empty((len(d), len(groups)), bool)
        for at, g in enumerate(groups):
            least = np.maximum(d - high[g][None, :], low[g][None, :] - d).max(axis=1)
            out[:, at] = least * (1 - SLACK) - SLACK <= limit[g]
        return out

    def tally(batches):
        total = np.zeros(len(groups), np.int64)
        for batch in byte_batches(batches):
            total += needed(of(batch, False)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(total)], names=["g", "n"])

    sizes = {r.g: r.n for r in data.mapInArrow(tally, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()} if len(groups) else {}
    data_parts = np.array([max(1, -(-sizes.get(g, 0) // cells.data_chunk)) for g in range(count)])
    query_parts = np.array([max(1, -(-int(asked[g]) // cells.query_chunk)) for g in range(count)])

    def deal(ask: bool):
        """Each row to the chunks of its groups: data meet every chunk of queries, queries every chunk of data."""
        def run(batches):
            for batch in byte_batches(batches, 1 << 20):
                d, mix = of(batch, ask), np.asarray(batch.column("h"))
                rows, g = (np.arange(len(d)), d.argmin(axis=1)) if ask else np.nonzero(needed(d))
                g = g if ask else groups[g]
                own = mix[rows] % (query_parts if ask else data_parts)[g]
                times = (data_parts if ask else query_parts)[g]
                at = np.repeat(np.arange(len(rows)), times)
                other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                a, b = (other, own[at]) if ask else (own[at], other)
                take = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([pa.array(g[at].astype(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)),
                                                  batch.column("id").take(take), batch.column("v").take(take)], names=["g", "a", "b", "id", "v"])
        return run

    unit = T.StructType([*(T.StructField(c, T.LongType()) for c in "gab"), T.StructField("id", kind), T.StructField("v", T.BinaryType())])
    mixed = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 40)).alias("h")
    left = asks.select("id", "v", mixed).mapInArrow(deal(True), unit)
    right = data.select("id", "v", mixed).mapInArrow(deal(False), unit)

    def solve(ask: pa.Table, given: pa.Table) -> pa.Table:
        if not ask.num_rows or not given.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([("query_id", ask.schema.field("id").type), ("vec", ask.schema.field("id").type), ("score", pa.int64())]))
        given = pa.table({"id": given.column("id"), "v": given.column("v")}).group_by(["id", "v"]).aggregate([])
        ask = pa.table({"id": ask.column("id"), "v": ask.column("v")}).group_by(["id", "v"]).aggregate([])
        x, y = matrix(ask.column("v")), matrix(given.column("v"))
        ids, names = np.asarray(given.column("id")), np.asarray(ask.column("id"))
        ys = y.astype(np.float64) if exact else y.astype(object)
        rows, cols, values = [], [], []
        for at in range(0, len(x), 256):
            part = x[at: at + 256]
            if exact:
                score = part.astype(np.float64) @ ys.T
            else:
                whole = np.array([[int((a.astype(object) * b).sum()) for b in ys] for a in part], dtype=object)
                score = np.clip(whole, -(2 ** 63), 2 ** 63 - 1)
            for r in range(len(part)):
                line = score[r]
                keep = np.flatnonzero(ids != names[at + r])
                if len(keep) > k:
                    if exact:
                        worst = np.partition(line[keep], len(keep) - k)[len(keep) - k]
                    else:
                        worst = sorted(line[keep])[-k]
                    keep = keep[line[keep] >= worst]
                order = sorted(keep, key=lambda c: (-int(line[c]), ids[c]))[:k]
                rows += [names[at + r]] * len(order)
                cols += [ids[c] for c in order]
                values += [int(line[c]) for c in order]
        same = ask.schema.field("id").type
        return pa.table({"query_id": pa.array(rows, same), "vec": pa.array(cols, same), "score": pa.array(values, pa.int64())})

    best = left.groupBy("g", "a", "b").cogroup(right.groupBy("g", "a", "b")).applyInArrow(solve, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")
