"""Chat formatting with a template that is only ever called, never looked into.

A template is a function from a list of (role, text) turns to a string. Successive prefixes of a conversation
are rendered; as long as each output begins with the one before, the added part is the new turn's
span. Rendering the same prefix with a stand-in for the last text shows where the text itself lies in that
span. A template whose output does not continue the previous one rewrites history: the conversation is reported as
such, its spans are unknown and nothing of it is put under the loss mask.

Control strings inside texts and roles are escaped before rendering and can be taken back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
STAND_IN = "\ue000\ue001\ue000"  # private-use characters; ``escape`` keeps them out of rendered texts


class Markup:
    """Turns between ``<|im_start|>role`` and ``<|im_end|>``. ``controls`` are all strings that must not come out of a
    text as they are, those of other common templates included."""

    controls = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", STAND_IN)
    _find = re.compile("|".join([r"\\", *map(re.escape, controls)]))
    _back = re.compile(r"\\([\\-])")
    _turn = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

    @classmethod
    def escape(cls, text: str) -> str:
        """A backslash is doubled; a control string gets backslash and hyphen after its first character."""
        return cls._find.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\-{m[0][1:]}", text)

    @classmethod
    def unescape(cls, text: str) -> str:
        return cls._back.sub(lambda m: "\\" if m[1] == "\\" else "", text)

    @classmethod
    def escape_role(cls, role: str) -> str:
        """As ``escape``; line breaks, which end the role, become the escaped letter n of a control string."""
        return cls.escape(role).replace("\n", "\\n")

    @classmethod
    def unescape_role(cls, role: str) -> str:
        return re.sub(r"\\([\\n-])", lambda m: {"\\": "\\", "n": "\n", "-": ""}[m[1]], role)

    @staticmethod
    def render(turns: Sequence[Turn]) -> str:
        return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)

    @classmethod
    def parse(cls, formatted: str) -> list[Turn]:
        """The turns of a formatted conversation, read from nothing but the formatted string."""
        out, at = [], 0
        for m in cls._turn.finditer(formatted):
            if m.start() != at:
                raise ValueError(f"unexpected text at {at}")
            out.append((cls.unescape_role(m[1]), cls.unescape(m[2])))
            at = m.end()
        if at != len(formatted):
            raise ValueError(f"unexpected text at {at}")
        return out


def spans(turns: Sequence[Turn], render: Callable[[Sequence[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """The rendered conversation; for each turn the start and end of its span and of its text in it; and the number
    of the first turn that rewrote what had been rendered before (-1: none; spans end before it)."""
    before, found = render([]), []
    for k in range(len(turns)):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            return render(turns), found, k
        probe = render([*turns[:k], (turns[k][0], STAND_IN)])
        at, text = probe.find(STAND_IN, len(before)), turns[k][1]
        rest = probe[at + len(STAND_IN):]
        if at < 0 or now != probe[:at] + text + rest:
            return render(turns), found, k
        found.append((len(before), len(now), at, at + len(text)))
        before = now
    return before, found, -1


OUT = T.StructType([
    T.StructField("formatted", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "text_start", "text_end")]
                                                    + [T.StructField("loss", T.BooleanType())]))),
    T.StructField("rewritten_at", T.LongType()),
])


LAYOUT = [pa.string(), pa.list_(pa.struct([*((n, pa.int64()) for n in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())])), pa.int64()]


def record_batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def format_conversations(turns: DataFrame, template=Markup, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``id_col``, formatted, spans (code points; ``loss``: the text is trained on),
    rewritten_at (-1, or the turn that made the template rewrite history).

    Turns are taken by ``turn_col`` (null last), equal ones by role and text; repeated rows stay. A null text or role
    counts as empty; rows without an id form one conversation. Other columns are not read; an empty table
    gives no rows. A conversation is the unit of a training example and is formatted in one task, streamed
    from partitions sorted by id; a task holds one conversation at a time.
    """
    src = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = src.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text")
    schema = T.StructType([T.StructField(id_col, turns.schema[id_col].dataType), *OUT.fields])

    def one(key, rows):
        safe = [(template.escape_role(r), template.escape(t)) for r, t in rows]
        formatted, found, broken = spans(safe, template.render)
        marked = [dict(zip(("start", "end", "text_start", "text_end"), s), loss=broken < 0 and rows[k][0] in loss_roles)
                  for k, s in enumerate(found)]
        return key, formatted, marked, broken

    def run(batches):
        key, rows, out, kinds = None, [], [], None
        for batch in batches:
            kinds = kinds or [batch.schema.field("id").type, *LAYOUT]
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text"))):
                if rows and i != key:
                    out.append(one(key, rows))
                    rows = []
                    if len(out) >= 256:
                        yield record_batch(out, kinds, schema.names)
                        out = []
                key = i
                rows.append((role, text))
        if rows:
            out.append(one(key, rows))
        if out:
            yield record_batch(out, kinds, schema.names)

    return dealt.mapInArrow(run, schema)


def read_back(formatted: DataFrame, template=Markup, id_col: str = "conv_id") -> DataFrame:
    """Digests read from formatted conversations alone: ``id_col``, n_turns, turns_sha256 (role, line break, text, line
    break of each turn), loss_chars and loss_sha256 (the texts under the loss mask, unescaped and joined), formatted_chars."""
    schema = T.StructType([T.StructField(id_col, formatted.schema[id_col].dataType), T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    src = formatted.select(F.col(id_col).alias("id"), "formatted",
                           F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: F.struct(s["text_start"].alias("a"), s["text_end"].alias("b"))).alias("mask"))

    def run(batches):
        sha = lambda parts: hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for key, text, mask in zip(*(batch.column(c).to_pylist() for c in ("id", "formatted", "mask"))):
                turns = template.parse(text)
                learnt = [template.unescape(text[m["a"]: m["b"]]) for m in mask]
                out.append((key, len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, learnt)), sha(learnt), len(text)))
            if out:
                yield record_batch(out, [batch.schema.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], schema.names)

    return src.mapInArrow(run, schema)
