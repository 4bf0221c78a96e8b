"""Regular-expression spans as DataFrame expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int>>"


def none() -> Column:
    return F.array().cast(SPAN)


def let(x: Column, use) -> Column:
    """``use(x)`` with ``x`` worked out once, wherever ``use`` needs it."""
    return F.transform(F.array(x), use)[0]


def chunks(xs: Column, width: int) -> Column:
    return let(xs, lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(width)), lambda i: F.slice(xs, i + 1, width)))


def before(xs: Column, join, levels: int = 3, width: int = 32) -> Column:
    """For each of the whole numbers ``xs`` those in front of it, joined (0 of none). Growing an array by one copies it, so chunks are joined
    on their own and what lies in front of a chunk is added afterwards: time grows in proportion up to ``width`` ** (``levels`` + 1) numbers."""
    def plain(ys):
        step = lambda acc, y: F.struct(join(acc["at"], y).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(ys, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    if not levels:
        return plain(xs)
    whole = lambda parts: F.transform(parts, lambda ys: F.aggregate(ys, F.lit(0), join))
    return let(chunks(xs, width), lambda parts: F.flatten(F.zip_with(
        parts, before(whole(parts), join, levels - 1, width), lambda ys, at: F.transform(plain(ys), lambda y: join(y, at)))))


def find(text: Column, kind: str, pattern: str, keep=None, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` (never empty ones) as spans in code points, end exclusive.

    ``keep(match, group text)`` drops failing matches afterwards, without a retry. Positions follow from the lengths of the
    matches and of the pieces between them. Texts without a match, most of them, are looked through once.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")
    one = lambda m, g: F.struct(F.length(m).alias("n"), (keep(m, g) if keep else F.lit(True)).alias("ok"))
    each = F.zip_with(found, part, one) if group else F.transform(found, lambda m: one(m, m))
    rows = F.zip_with(each, between, lambda x, b: F.struct(F.length(b).alias("b"), x["n"].alias("n"), x["ok"].alias("ok")))

    def placed(rows):
        rows = F.filter(rows, lambda r: r["n"].isNotNull())  # the piece behind the last match has none
        return let(rows, lambda rows: F.filter(F.zip_with(
            rows, before(F.transform(rows, lambda r: r["b"] + r["n"]), lambda a, b: a + b), lambda r, at: F.when(r["ok"], F.struct(
                F.lit(kind).alias("kind"), (at + r["b"]).alias("start"), (at + r["b"] + r["n"]).alias("end")))), lambda s: s.isNotNull()))

    return F.when(text.rlike(pattern), placed(rows)).otherwise(none()).cast(SPAN)


def rank(kinds: list[str], kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, kinds)), kind).cast("int")


def joined(spans: Column, kinds: list[str], by: str) -> Column:
    """kind:start:end, comma-joined; ``by`` is "start" (then kind as listed) or "kind" (then start)."""
    first = lambda s: (s["start"], rank(kinds, s["kind"])) if by == "start" else (rank(kinds, s["kind"]), s["start"])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(
        first(s)[0].alias("a"), first(s)[1].alias("b"), s["end"].alias("e"), s["kind"].alias("kind"), s["start"].alias("start"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["e"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark) -> Column:
    """``text`` with every span replaced by ``mark(kind)``; of overlapping spans the first stands for all they cover."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))

    def pieces(order):
        covered = before(F.transform(order, lambda s: s["e"]), lambda a, b: F.greatest(a, b))  # up to where the spans in front reach
        own = F.filter(F.zip_with(order, covered, lambda s, at: F.struct(at.alias("at"), s["s"].alias("s"), s["k"].alias("k"))), lambda x: x["s"] >= x["at"])
        # a piece is cut out of the stretch of its chunk, as finding a place in a text takes time by its distance from the beginning
        cut = lambda xs: let(F.struct(xs[0]["at"].alias("low"), F.substring(text, xs[0]["at"] + 1, F.element_at(xs, -1)["s"] - xs[0]["at"]).alias("t")),
                             lambda c: F.array_join(F.transform(xs, lambda x: F.concat(F.substring(c["t"], x["at"] - c["low"] + 1, x["s"] - x["at"]), mark(x["k"]))), ""))
        end = F.array_max(F.transform(order, lambda s: s["e"]))
        return F.concat(F.array_join(F.transform(chunks(own, 64), cut), ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(order, pieces)).otherwise(text)
