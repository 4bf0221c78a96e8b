"""Personal data: generators propose candidates, boosted trees judge them, calibrated thresholds select.

Four base rules (address, network address, card, phone) are exact patterns with a check; what they find is always
selected. Besides, generous generators propose further, overlapping spans of the same four kinds: written-out
addresses, numbers without a plus sign or with odd separators, numbers within longer runs of them. Each candidate has features of
its format and context.

The trees' labels do not repeat the base rules' verdict on a text, they are known by construction: what the base rules find is
written in other ways that mean the same (positive), and spoilt so that it means nothing, in the same ways (negative): a wrong check digit, a part
out of range, digits regrouped as sums, lists and dates, an address of numbers. Candidates of the corpus that fail their kind's check are negative,
too; those that pass it without being base spans are left open, for they are what is looked for. Trees are boosted on a bounded sample
of these rows of all documents, and each kind gets the lowest threshold that is precise enough on all rows the trees have not
seen. Candidates over it that touch no base span are selected, the likeliest first where they overlap.

The fit stores the features of all rows once and counts them by score; the scan is one projection: DataFrame
functions only, no shuffle. Time grows in proportion to the findings of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .boosting import Boosted, fit as boost
from .common import stored

KINDS = ["email", "ip", "card", "phone"]
NEAR = [f"near_{k}" for k in KINDS]

# A run of an address's first characters is entered at its start, or where the last match ended, so that a run
# without an @ is read once. Quantifiers are possessive where what follows cannot lie in the run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

GENERATORS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}"
              r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,6}+", r"@|\(at\)|\[at\]"),
    "ip": (r"(?<![0-9])[0-9]{1,4}+(?:\x20?[.,:]\x20?[0-9]{1,4}+){3}+", r"[0-9][.,:\x20]"),
    "number": (r"\+?\(?[0-9](?:[\x20()./-]{0,3}+[0-9]){7,}+", r"[0-9]{2}"),
    # parts of longer runs, which a base rule takes whole and then drops: a phone beside a card, say
    "solid": (r"(?<![0-9])[0-9]{8,19}+(?![0-9])", r"[0-9]{8}"),
    "dialled": (r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"\+[0-9]"),
}


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The check digit fits; ``d`` holds 13 to 19 digits (false otherwise)."""
    back = F.reverse(d)

    def add(acc, i):
        x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    fits = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0
    return F.when(F.length(d).between(13, 19), fits).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """Spans of the four base rules; ``text`` must not be null."""
    return F.concat(
        F.when(F.contains(text, F.lit("@")), S.find(text, "email", EMAIL)).otherwise(S.none()),
        S.find(text, "ip", IP, lambda m, g: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        S.find(text, "card", CARD, lambda m, g: luhn(digits(m))),
        F.when(F.contains(text, F.lit("+")), S.find(text, "phone", PHONE, lambda m, g: F.length(digits(m)).between(9, 15))).otherwise(S.none()))


def proposed(text: Column) -> Column:
    """Spans of the generators, in order."""
    return F.array_sort(F.transform(F.concat(*[F.when(text.rlike(hint), S.find(text, kind, pattern)).otherwise(S.none())
                                                for kind, (pattern, hint) in GENERATORS.items()]),
                                     lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def candidates(text: Column, found: Column) -> Column:
    """The proposed spans with their text, up to 24 characters before and one after. Numbers of 13 digits or
    more are card candidates, shorter ones and those that are dialled (a plus, a parenthesis, two zeros first) phone candidates."""
    def with_context(s, t, low):
        m = F.substring(t, s["start"] - low + 1, s["end"] - s["start"])
        kind = F.when(s["kind"].isin("email", "ip"), s["kind"]).when((F.length(digits(m)) >= 13) & ~m.rlike(r"^00|[+(]"), "card").otherwise("phone")
        room = F.least(F.lit(24), s["start"])
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), m.alias("m"),
                        F.substring(t, s["start"] - low - room + 1, room).alias("before"), F.substring(t, s["end"] - low + 1, F.lit(1)).alias("next"))

    def of_chunk(xs):  # out of the stretch of text that a few spans share, as finding a place takes time by its distance
        low = F.greatest(xs[0]["start"] - 24, F.lit(0))
        high = F.array_max(F.transform(xs, lambda x: x["end"])) + 1
        return S.let(F.struct(low.alias("low"), F.substring(text, low + 1, high - low).alias("t")),
                     lambda c: F.transform(xs, lambda x: with_context(x, c["t"], c["low"])))

    kinds = "array<struct<kind:string,start:int,end:int,m:string,before:string,next:string>>"
    return F.when(F.size(found) > 0, F.flatten(F.transform(S.chunks(found, 32), of_chunk))).otherwise(F.array().cast(kinds))


def written(c: Column) -> Column:
    """A true find ``c`` in other ways (y = 1) and spoilt ones (y = 0), as (kind, m, before, next, y)."""
    m, d = c["m"], digits(c["m"])
    at = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    numbers = lambda x: F.regexp_replace(x, "[A-Za-z]", "1")
    groups = lambda d, n, by: F.regexp_replace(d, f"(.{{{n}}})(?=.)", f"$1{by}")
    wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((F.substring(d, -1, 1).cast("int") + 1) % 10).cast("string"))
    beyond = F.concat((F.regexp_extract(m, "^([0-9]+)", 1).try_cast("int") + 400).cast("string"), F.regexp_extract(m, "^[0-9]+(.*)$", 1))
    ways = {
        "email": ([m, F.concat(at[0], F.lit(" (at) "), F.replace(at[1], F.lit("."), F.lit(" (dot) "))),
                   F.concat(at[0], F.lit("[at]"), F.replace(at[1], F.lit("."), F.lit("[dot]"))), F.concat(at[0], F.lit(" (at) "), at[1]),
                   F.concat(at[0], F.lit(" @ "), at[1])],
                  [F.concat(numbers(at[0]), F.lit(x), numbers(at[1])) for x in (" @ ", "@", " (at) ")]),
        "ip": ([m, F.replace(m, F.lit("."), F.lit(" . ")), F.replace(m, F.lit("."), F.lit(". "))],
               [F.replace(beyond, F.lit("."), F.lit(x)) for x in (".", " . ", ". ")]
               + [F.replace(m, F.lit("."), F.lit(x)) for x in (", ", ",", ":")]),
        "card": ([d, *[groups(d, 4, x) for x in (" ", "-", ".", "  ", "/")]],
                 [wrong, *[groups(wrong, 4, x) for x in (" ", "-", ".", "  ", "/")]]),
        "phone": ([m, F.regexp_replace(m, "^[+]", ""), F.regexp_replace(m, "^[+]", "00"), F.regexp_replace(m, "[^0-9+]+", "."),
                   *[F.regexp_replace(F.substring(m, F.lit(2), F.length(m)), "[^0-9]+", x) for x in ("-", ".", "/")]],
                  [d, groups(d, 2, " "), groups(d, 1, " "), groups(d, 5, "-"),
                   *[F.reverse(groups(F.reverse(F.substring(d, F.lit(1), F.length(d) - less)), 3, x)) for less in (0, 1, 2) for x in (".", " ")],
                   F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-0"), F.substring(d, 3, 1), F.lit("-1"), F.substring(d, 4, 1), F.lit(" "), F.substring(d, 5, 2))]),
    }
    row = lambda kind, m, y, glued=False: F.struct(
        F.lit(kind).alias("kind"), F.regexp_replace(m, "^-", "").alias("m"), (F.concat(c["before"], F.lit("e")) if glued else c["before"]).alias("before"),
        (F.lit("f") if glued else c["next"]).alias("next"), F.lit(y).alias("y"))
    out = F.array().cast("array<struct<kind:string,m:string,before:string,next:string,y:int>>")
    for kind, (good, bad) in ways.items():
        rows = [row(kind, x, 1) for x in good] + [row(kind, x, 0) for x in bad]
        if kind in ("card", "phone"):
            rows += [row(kind, d, 0, glued=True)]  # digits within a word
        if kind == "phone":
            rows += [row("ip", F.regexp_replace(F.substring(m, F.lit(2), F.length(m)), "[^0-9]+", x), 0) for x in (".", ". ")]
        if kind == "ip":
            rows += [row("phone", F.replace(m, F.lit("."), F.lit(x)), 0) for x in (".", " . ", ". ", " ")]
        out = F.when(c["kind"] == kind, F.array(*rows)).otherwise(out)
    return out


def fails(c: Column) -> Column:
    """A candidate that cannot be what its kind stands for."""
    d = digits(c["m"])
    glued = c["before"].rlike("[A-Za-z0-9]$") | c["next"].rlike("[A-Za-z0-9]")
    return (F.when(c["kind"] == "ip", ~c["m"].rlike(rf"^{PART}(?:[^0-9]+{PART}){{3}}$")).when(c["kind"] == "card", ~luhn(d) | glued)
            .when(c["kind"] == "phone", ~F.length(d).between(9, 15) | glued).otherwise(F.lit(False)))


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, all numbers."""
    m, d = c["m"], digits(c["m"])
    kinds = F.regexp_count
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return {k: number(v) for k, v in {
        **{f"is_{k}": (c["kind"] == k).cast("int") for k in KINDS},
        "length": F.length(m), "digits": F.length(d), "groups": kinds(m, F.lit("[0-9]+")), "blanks": kinds(m, F.lit(r"\x20")),
        "dots": kinds(m, F.lit(r"\.|\(dot\)|\[dot\]")), "dashes": kinds(m, F.lit("-")), "slashes": kinds(m, F.lit("[/,:]")),
        "plus": m.startswith("+").cast("int"), "letters": kinds(m, F.lit("[A-Za-z]")),
        "ending": F.length(F.regexp_extract(m, "([A-Za-z]+)$", 1)), "luhn": luhn(d).cast("int"),
        "parts_fit": m.rlike(rf"^{PART}(?:[^0-9]+{PART}){{3}}$").cast("int"),
        "glued_before": c["before"].rlike("[A-Za-z0-9.+-]$").cast("int"), "glued_after": c["next"].rlike("[A-Za-z0-9_-]").cast("int"),
        "first_group": F.length(F.regexp_extract(m, "[0-9]+", 0)), "last_group": F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)),
        "named_before": F.lower(c["before"]).rlike("mail|phone|tel|call|fax|card|host|addr|contact|ip").cast("int"),
    }.items()}


FEATURES = (
    *[f"is_{k}" for k in KINDS], "length", "digits", "groups", "blanks", "dots", "dashes", "slashes", "plus", "letters", "ending", "luhn", "parts_fit",
    "glued_before", "glued_after", "first_group", "last_group", "named_before")


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: dict  # kind -> least score; kinds without one select nothing

    def sure(self, free: Column) -> Column:
        """Of candidates, those over their kind's threshold, with their score."""
        cut = F.create_map(*[F.lit(x) for kv in sorted(self.thresholds.items()) for x in kv])
        judged = lambda c: S.let(F.struct(*[v.alias(k) for k, v in features(c).items()]), lambda x: self.trees.column({k: x[k] for k in FEATURES}))
        scored = F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), judged(c).alias("p")))
        return F.filter(scored, lambda c: F.coalesce(c["p"] >= cut[c["kind"]], F.lit(False)))


FAR = 1 << 30  # beyond any place in a text


def apart(found: Column, base: Column) -> Column:
    """The spans of ``found`` (in order of their start) that meet none of ``base``: of the base spans that begin before one, the furthest end, and
    of those that begin later, the nearest start tell."""
    both = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("s"), b["end"].alias("e"), F.lit(-1).alias("i"))),
        F.transform(found, lambda c, i: F.struct(c["start"].alias("s"), c["end"].alias("e"), i.alias("i")))))

    def keep(both):
        most = lambda a, b: F.greatest(a, b)
        ends = S.before(F.transform(both, lambda x: F.when(x["i"] < 0, x["e"]).otherwise(0)), most)
        nexts = F.reverse(S.before(F.reverse(F.transform(both, lambda x: F.when(x["i"] < 0, FAR - x["s"]).otherwise(0))), most))
        near = F.zip_with(ends, nexts, lambda e, n: F.struct(e.alias("e"), (FAR - n).alias("s")))
        free = F.zip_with(both, near, lambda x, n: F.when((x["i"] >= 0) & (n["e"] <= x["s"]) & (n["s"] >= x["e"]), x["i"]))
        return F.transform(F.filter(free, lambda i: i.isNotNull()), lambda i: F.get(found, i))

    return F.when(F.size(base) > 0, S.let(both, keep)).otherwise(found)


def likeliest(sure: Column) -> Column:
    """Of spans in order of their start, those left when the likeliest go first and what meets them goes. Spans fall into clusters that do not
    meet, each chosen from on its own."""
    def greedy(xs):
        order = F.array_sort(F.transform(xs, lambda x: F.struct((-x["p"]).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        none = F.slice(order, 1, 0)
        meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
        left = F.aggregate(order, none, lambda acc, c: F.when(F.exists(acc, lambda s: meets(s, c)), acc).otherwise(F.concat(acc, F.array(c))))
        return F.transform(left, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), (-c["p"]).alias("p")))

    def clusters(xs):
        reach = S.before(F.transform(xs, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        first = F.filter(F.transform(F.zip_with(xs, reach, lambda x, e: x["start"] >= e), lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
        return S.let(first, lambda first: F.zip_with(first, F.concat(F.slice(first, 2, FAR), F.array(F.size(xs))), lambda a, b: F.slice(xs, a + 1, b - a)))

    return S.let(sure, lambda xs: F.when(F.size(xs) > 0, F.flatten(F.transform(clusters(xs), greedy))).otherwise(F.slice(xs, 1, 0)))


STEPS = 1 << 14  # of a score; a power of two, so that scaling is exact


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_candidates: int = 20_000, precision: float = 0.99) -> Model:
    """Fit on what the base rules find in all documents, written in other ways and spoilt, and on candidates that fail their check. The trees see
    at most about ``sample_candidates`` different rows, by a hash of id and row up to as many of every kind and label, and none of the
    other half by that hash. Thresholds come from the counts by score of all rows the trees have not seen (if no positive
    one of a kind is among them, of all rows of that kind). A kind that the base rules never find is not learnt, and without
    rows of both labels nothing is selected beyond the base rules."""
    found = _found(docs, text_col, {"id": F.col(id_col)}).select("id", "base", F.explode("found").alias("c"))
    true = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")))
    c = F.col("c")
    own = F.array(F.struct(*[c[k].alias(k) for k in ("kind", "m", "before", "next")], F.lit(0).alias("y")))
    made = found.select("id", F.explode(F.when(true, written(c)).when(fails(c), own)).alias("c"))
    x = features(F.col("c"))
    rows = stored(made.select(F.xxhash64(F.lit(11), "id", "c").alias("h"), F.col("c.kind").alias("kind"), F.col("c.y").alias("y"),
                              *[v.alias(k) for k, v in x.items()]), "candidates")
    half = F.col("h").bitwiseAND(F.lit(1)) == 0
    sizes = rows.where(half).groupBy("kind", "y").agg(F.approx_count_distinct("h").alias("n")).collect()
    if {r["y"] for r in sizes} != {0, 1}:
        return Model(Boosted(0.0, ()), {})
    each = sample_candidates / (2 * len(KINDS))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (f"{r['kind']}{r['y']}", min(1.0, each / max(1, r["n"])))])
    u = F.pmod(F.shiftright("h", 1), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = half & F.coalesce(u < share[F.concat("kind", F.col("y").cast("string"))], F.lit(False))
    sample = sorted(rows.where(drawn).dropDuplicates(["h"]).collect(), key=lambda r: (r["h"], r["kind"]))
    trees = boost({k: np.array([r[k] for r in sample]) for k in x}, np.array([r["y"] for r in sample]), rounds=40, depth=4)
    step = F.floor(trees.column({k: F.col(k) for k in x}) * F.lit(float(STEPS))).cast("int")
    counts = rows.groupBy("kind", drawn.alias("drawn"), step.alias("step"), "y").agg(F.count("*").alias("n")).collect()
    cuts = {}
    for k in KINDS:
        mine = [r for r in counts if r["kind"] == k]
        unseen = [r for r in mine if not r["drawn"]]
        n = np.zeros((2, STEPS + 1), np.int64)
        for r in unseen if any(r["y"] for r in unseen) else mine:
            n[r["y"], r["step"]] += r["n"]
        n = n[:, ::-1]
        right, every = np.cumsum(n[1]), np.cumsum(n.sum(axis=0))
        if (good := np.flatnonzero((n.sum(axis=0) > 0) & (right / np.maximum(1, every) >= precision))).size:
            cuts[k] = max(STEPS // 2, STEPS - int(good[-1])) / STEPS
    return Model(trees, cuts)


def _found(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """``keep``, base (spans of the base rules) and found (candidates) of every row."""
    src = docs.select(*[v.alias(k) for k, v in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    spans = src.select(*keep, "__text", base_spans(F.col("__text")).alias("base"), proposed(F.col("__text")).alias("found"))
    return spans.select(*keep, "base", candidates(F.col("__text"), F.col("found")).alias("found"))


def scan(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base (spans of the base rules) and near (the further spans the trees select) of every row. A null text
    counts as empty and has no spans; repeated rows come back as often; an empty table gives no rows."""
    found = _found(docs, text_col, {f"__keep{i}": F.col(c) for i, c in enumerate(keep)})
    mine = [f"__keep{i}" for i in range(len(keep))]
    near = F.lit(None)
    if model.thresholds:  # one step after the other, as each refers to the last one's result several times
        found = found.select(*mine, "base", apart(F.col("found"), F.col("base")).alias("free"))
        found = found.select(*mine, "base", model.sure(F.col("free")).alias("sure"))
        near = F.transform(likeliest(F.col("sure")), lambda c: F.struct(F.concat(F.lit("near_"), c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select(*[F.col(m).alias(c) for m, c in zip(mine, keep)], "base", F.coalesce(near.cast(S.SPAN), S.none()).alias("near"))
