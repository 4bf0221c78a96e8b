"""Fill-in-the-middle examples, cut at line ends that a learned rank index finds.

The rank index maps k to the offset behind the k-th line of a text. It holds no offsets: segments (a first rank, an offset and a slope) predict
them within a fixed error, and one small residual a line corrects the prediction exactly. A segment is the line through
its first and last offset, moved to the middle of its errors; one whose error is too large is halved until it fits, all
segments of all texts of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches

MARKS = ("<P>", "<S>", "<M>")  # fixed by the task: prefix, suffix, middle


@dataclass(frozen=True)
class Plan:
    seed: str = "7:"  # before the id, in the text whose sha256 decides
    rate: int = 100  # percent of texts that are cut
    spm: int = 50  # percent of those whose suffix comes first
    error: int = 1000  # most that a prediction of the index is off, in bytes


class RankIndex:
    """Exact offsets by rank over several rising sequences, one behind the other: ``offsets`` holds all, ``first`` where each begins."""

    def __init__(self, offsets: np.ndarray, first: np.ndarray, error: int):
        y = offsets.astype(np.int64)
        n = len(y)
        residual = np.zeros(n, np.int16 if error < 1 << 15 else np.int64)
        low, high = first.astype(np.int64), np.append(first[1:], n).astype(np.int64)
        done = []
        while len(low):
            size = high - low
            starts = np.cumsum(size) - size
            at = np.repeat(low - starts, size) + np.arange(size.sum())
            slope = (y[high - 1] - y[low]) / np.maximum(1, size - 1)
            off = y[at] - self._line(np.repeat(low, size), np.repeat(y[low], size), np.repeat(slope, size), at)
            least, most = np.minimum.reduceat(off, starts), np.maximum.reduceat(off, starts)
            move = (least + most) // 2
            fits = most - move <= error
            fits &= move - least <= error
            good = np.repeat(fits, size)
            residual[at[good]] = (off - np.repeat(move, size))[good]
            done.append((low[fits], y[low[fits]] + move[fits], slope[fits]))
            low, high = low[~fits], high[~fits]
            middle = (low + high) // 2
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        self.residual = residual
        parts = [np.concatenate(p) for p in zip(*done)] if done else [np.zeros(0, np.int64)] * 3
        order = np.argsort(parts[0])
        self.start, self.base, self.slope = (p[order] for p in parts)

    @staticmethod
    def _line(start, base, slope, at):
        return base + np.floor(slope * (at - start)).astype(np.int64)

    def predicted(self, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.start, at, "right") - 1
        return self._line(self.start[k], self.base[k], self.slope[k], at)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The offsets at these places of the whole sequence."""
        return self.predicted(at) + self.residual[at]


def boundaries(cuts: np.ndarray, raw: np.ndarray):
    """(offsets, first): of each text of a batch (bytes ``cuts[i]`` to ``cuts[i + 1]`` of ``raw``) its beginning and the offsets behind its
    lines; the last line may lack its line end. ``first`` is where each text's own begin."""
    ends = np.flatnonzero(raw == 10) + 1
    bare = (cuts[1:] > cuts[:-1]) & (raw[np.maximum(cuts[1:], 1) - 1] != 10) if len(raw) else np.zeros(len(cuts) - 1, bool)
    lines = np.searchsorted(ends, cuts[1:], "right") - np.searchsorted(ends, cuts[:-1], "right")
    count = 1 + lines + bare
    first = np.cumsum(count) - count
    offsets = np.empty(count.sum(), np.int64)
    own = np.repeat(np.arange(len(count)), count)
    rank = np.arange(len(offsets)) - first[own]
    offsets[rank == 0] = cuts[:-1]
    offsets[(rank > 0) & (rank <= lines[own])] = ends
    offsets[(first + count - 1)[bare]] = cuts[1:][bare]
    return offsets, first, count - 1


def _cuts(plan: Plan):
    def places(body: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        """Lines of each text and the bytes in front of its two cuts."""
        out = []
        for batch in byte_batches([pa.RecordBatch.from_arrays([body, h1, h2], ["body", "h1", "h2"])], 1 << 20):
            body = batch.column("body")
            cuts = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, body.offset * 4).astype(np.int64)
            raw = np.frombuffer(body.buffers()[2], np.uint8, cuts[-1] - cuts[0], cuts[0]) if cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
            cuts -= cuts[0]
            offsets, first, n = boundaries(cuts, raw)
            index = RankIndex(offsets, first, plan.error)
            a, b = (np.asarray(batch.column(c)) % (n + 1) for c in ("h1", "h2"))
            low, high = (index[first + f(a, b)] - cuts[:-1] for f in (np.minimum, np.maximum))
            out.append(pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (n, low, high)], ["n", "low", "high"]))
        kind = pa.struct([(c, pa.int32()) for c in ("n", "low", "high")])
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return F.arrow_udf(places, "struct<n:int,low:int,high:int>")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``id_col``, n (lines), form ("plain", "psm" or "spm"), output, prefix_chars and middle_chars (code points; null for plain).

    A text is cut behind two of its lines, or before the first, as the sha256 of the seed and the id decides, and put together with marks in
    the order of its form. It stays as it is (plain) if it is empty, holds a mark, or falls outside ``plan.rate``. Null
    texts count as empty, a null id as an id without digits; rows that repeat give equal rows. Other columns,
    whatever their names, are not read; an empty table gives no rows. No shuffle; a text is one value of its row, and only the
    places of its cuts come from Python.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(plan.seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), *h)
    marked = F.contains("t", F.lit(MARKS[0])) | F.contains("t", F.lit(MARKS[1])) | F.contains("t", F.lit(MARKS[2]))
    form = F.when((F.col("t") == "") | marked | (F.col("h3") % 100 >= plan.rate), "plain").when(F.col("h4") % 100 < plan.spm, "spm").otherwise("psm")
    body = F.col("t").cast("binary")
    rows = rows.select("id", form.alias("form"), body.alias("body"), _cuts(plan)(body, "h1", "h2").alias("cut"))
    part = lambda a, b: F.substring("body", a + 1, b - a)
    low, high, end = F.col("cut.low"), F.col("cut.high"), F.octet_length("body")
    rows = rows.select("id", "form", F.col("cut.n").cast("long").alias("n"), "body", *[part(*x).cast("string").alias(c) for c, x in (
        ("pre", (F.lit(0), low)), ("mid", (low, high)), ("suf", (high, end)))])
    p, s, m = map(F.lit, MARKS)
    output = (F.when(F.col("form") == "plain", F.col("body").cast("string")).when(F.col("form") == "psm", F.concat(p, "pre", s, "suf", m, "mid"))
              .otherwise(F.concat(s, "suf", p, "pre", m, "mid")))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    return rows.select(F.col("id").alias(id_col), "n", "form", output.alias("output"), chars("pre").alias("prefix_chars"), chars("mid").alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Texts that are cut hold no marks, so the marks of the output divide its parts."""
    p, s, m = map(F.lit, MARKS)
    between = lambda a, b: F.split_part(F.split_part(output, a, F.lit(2)), b, F.lit(1))
    last = F.split_part(output, m, F.lit(2))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), last, between(s, m)))
            .otherwise(F.concat(between(p, m), last, between(s, p))))
