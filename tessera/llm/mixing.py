"""Mixing sources to target weights by entropy balancing.

Of all document rates that meet the token constraints, entropy balancing takes those closest (in relative entropy
weighted by tokens) to taking every document once. Its solution is an exponential tilt: the rate of a document is the
exponential of the sum of one multiplier for each group it belongs to. The convex dual has one variable for each
constraint, and Newton's method solves it. Several margins (source, language, ...) are balanced by turns, as the Hessian is
diagonal within each of them: a turn needs only the tokens of the margin's groups at the current rates, an aggregation over the table of
group combinations that Spark derives from all documents, and takes every step of each group on its row. Each query of a turn costs the
driver memory, however small the tables are; one margin needs one turn.

Rates are rounded into copies so that every document gets the whole number below or above its rate and every source's tokens come
as near to its target as a document allows: documents of a source are ordered by size, the copies follow the running sum
of rates, and what is then still missing (or too much) is settled with the smallest documents and one of fitting size. All windows run over
counts by source and size, or within groups of one size split by ``SALTS``; no window holds all rows of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 256


def words(text):
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, size).

    Sources by code point, null last, weigh ``cycle``, repeating, and share all tokens by weight; a target stops at ``most`` times its
    source's size and the excess is shared anew by weight among the others. The level at which that ends is found at once: in the order of
    size / weight, the sources before it are full and the others get the rest by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.array(*map(F.lit, cycle))[(place % len(cycle)).cast("int")]
    ranked = per.withColumn("weight", weight).withColumn("full", most * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    # the first source in that order that is not filled sets the level of all
    found = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return leveled.select("source", "source_size", F.coalesce(F.least(F.col("full"), F.col("weight") * found), "full").alias("target"))


def balance(cells: DataFrame, margins: dict[str, DataFrame], tokens: str = "tokens", steps: int = 40, near: float = 1e-12) -> DataFrame:
    """``cells`` with ``rate``: the exponential tilt under which the tokens of every group of every margin meet its target.

    ``cells``: one row per combination of groups with its tokens; ``margins``: column -> (column, target). Null is a group like another.
    A target of 0, and one of a group without tokens, leaves rate 0 and 1 there. ``steps`` bounds the turns, and the Newton steps of a
    turn; with several margins the turns end when no group is further than ``near`` from its target, in shares of it.
    """
    state = {c: t.select(F.col(c).alias("g"), F.col("target").cast("double").alias("target"), F.lit(0.0).alias("lam")) for c, t in margins.items()}

    def rated():
        out, total = cells, F.lit(0.0)
        for k, (c, lam) in enumerate(state.items()):
            mine = lam.select(F.col("g").alias(f"__g{k}"), F.col("lam").alias(f"__l{k}"))
            out = out.join(mine, F.col(c).eqNullSafe(F.col(f"__g{k}")), "left").drop(f"__g{k}")
            total = total + F.coalesce(f"__l{k}", F.lit(0.0))
        return out.withColumn("rate", F.exp(total)).drop(*[f"__l{k}" for k in range(len(state))])

    def step(by, _):
        # gradient target - now, Hessian now; the first steps are kept short where the curve is far from a parabola
        now = F.col("now") * F.exp(by)
        return by + F.greatest(F.lit(-1.0), F.least(F.lit(1.5), (F.col("target") - now) / now))

    for _ in range(steps):
        worst = 0.0
        for c in margins:
            now = rated().groupBy(F.col(c).alias("h")).agg(F.sum(F.col(tokens) * F.col("rate")).alias("now"))
            both = state[c].join(now, F.col("g").eqNullSafe(F.col("h")), "left").drop("h").withColumn("now", F.coalesce("now", F.lit(0.0)))
            move = F.when(F.col("now") <= 0, 0.0).when(F.col("target") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)).otherwise(-800.0 - F.col("lam"))
            off = F.when((F.col("now") > 0) & (F.col("target") > 0), F.abs(F.col("now") / F.col("target") - 1)).otherwise(0.0)
            done = stored(both.select("g", "target", (F.col("lam") + move).alias("lam"), off.alias("off")), "dual")
            if len(margins) > 1:
                worst = max(worst, done.agg(F.max("off")).first()[0] or 0.0)
            state[c] = done.drop("off")
        if worst <= near:
            break
    return rated()


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: Sequence[float] = (1.0, 2.0, 3.0),
        most: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` columns, source, size, source_size, target, copies and taken (copies * size) of every row.

    Null and empty texts have size 0 and one copy; they take nothing. A null source is a source like another. Repeated rows are
    rounded one by one, equal ones may differ by a copy; no copies exceed ``most``. Other columns are not read; an empty
    table gives no rows.
    """
    # a source that is never null: joins and windows then agree on how rows are dealt
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__k{k}") for k, c in enumerate(keep)], src.alias("src"),
                       words(F.col(text_col)).alias("size"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"))
    cells = stored(base.groupBy("src", "size", "salt").agg(F.count("*").alias("n")), "mix-cells")
    named = F.when(F.col("src") != "", F.substring("src", 2, 1 << 30))
    sizes = cells.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("size")).select(named.alias("source"), "size")
    sizes = stored(sizes, "mix-sizes")
    targets = stored(source_targets(sizes, cycle, most), "mix-targets")
    rates = balance(sizes.withColumnRenamed("size", "tokens"), {"source": targets}).select(F.col("source").alias("s"), F.round("rate", 9).alias("rate"))
    per = targets.join(rates, F.col("source").eqNullSafe(F.col("s"))).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), "source_size", "target", "rate")

    # copies by source and size: floor(rate) each, and one more for as many as the running sum of rates asks for
    level = cells.groupBy("src", "size").agg(F.sum("n").alias("n")).join(per, "src")
    up = Window.partitionBy("src").orderBy("size")
    low, part = F.floor("rate"), F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0)
    level = level.withColumn("upto", F.sum("n").over(up))
    level = level.withColumn("more", F.floor(part * F.col("upto") + 0.5) - F.floor(part * (F.col("upto") - F.col("n")) + 0.5))
    level = level.withColumn("missing", F.col("target") - F.sum(F.col("size") * (low * F.col("n") + F.col("more"))).over(Window.partitionBy("src")))
    room = F.when(part <= 0, 0).when(F.col("missing") >= 0, F.col("n") - F.col("more")).otherwise(F.col("more"))
    level = level.withColumn("room", room).withColumn("covered", F.sum(F.col("room") * F.col("size")).over(up))
    left = F.abs("missing") - (F.col("covered") - F.col("room") * F.col("size"))
    swap = F.greatest(F.lit(0), F.least(F.col("room"), F.floor(left / F.greatest("size", F.lit(1)))))
    level = level.withColumn("swap", swap)
    # and one document more of the size nearest to what is then left
    rest = F.abs("missing") - F.sum(F.col("swap") * F.col("size")).over(Window.partitionBy("src"))
    level = level.withColumn("rest", rest)
    off = F.abs(F.col("rest") - F.col("size"))
    best = F.min(F.when((F.col("room") > F.col("swap")) & (off < F.col("rest")), F.struct(off, "size"))).over(Window.partitionBy("src"))["size"]
    swap = F.col("swap") + F.when(F.col("size") == best, 1).otherwise(0)
    more = F.col("more") + F.when(F.col("missing") >= 0, swap).otherwise(-swap)
    level = level.select("src", "size", "source_size", "target", "rate", more.alias("more"))
    # dealt to the salts of a size in turn, then to the rows of a salt
    turn = Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    dealt = cells.withColumn("before", F.coalesce(F.sum("n").over(turn), F.lit(0))).join(level, ["src", "size"])
    dealt = dealt.select("src", "size", "salt", "source_size", "target", "rate", (F.col("more") - F.col("before")).alias("take"))
    nth = F.row_number().over(Window.partitionBy("src", "size", "salt").orderBy("__id"))
    rows = base.join(dealt, ["src", "size", "salt"]).withColumn("nth", nth)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor("rate") + F.when(F.col("nth") <= F.col("take"), 1).otherwise(0)).cast("long")
    return rows.select(F.col("__id").alias(id_col), *[F.col(f"__k{k}").alias(c) for k, c in enumerate(keep)], named.alias("source"), "size",
                       "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
