"""Connected components of an edge table by contraction, all in DataFrames.

In each round every node points to one node of its closed neighbourhood, and the edges between the nodes
pointed to go on to the next round until none is left. Even rounds choose the least id, which
contracts a star around its least node at once; odd rounds choose by a hash of id and round, which leaves a
constant share of the nodes in expectation on every graph, long chains included. What a round made is written to
the shared folder, so the plan does not grow and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``edges`` with the least node it is connected to. Loops and repeated edges are
    harmless; an edge with a null end is ignored."""
    left = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels, rounds = None, 0
    while not left.isEmpty():
        key = (lambda c: F.xxhash64(F.lit(rounds), c)) if rounds % 2 else (lambda c: c)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(key(F.col("b")).alias("k"), "b")).alias("m"))
        own = F.struct(key(F.col("a")).alias("k"), F.col("a").alias("b"))
        points = stored(least.select(F.col("a").alias("v"), F.least("m", own)["b"].alias("to")), "points")
        ends = left.join(points.withColumnRenamed("v", "a").withColumnRenamed("to", "ta"), "a")
        ends = ends.join(points.withColumnRenamed("v", "b").withColumnRenamed("to", "tb"), "b")
        left = stored(ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = points.select(F.col("v").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(points, F.col("root") == F.col("v"), "left").select("node", F.coalesce("to", "root").alias("root"))
            if rounds % 4 == 3:
                labels = stored(labels, "labels")
        rounds += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = stored(labels, "labels")
    first = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(first, "root").select("node", "component")
