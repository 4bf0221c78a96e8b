import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm.queries import QUERIES

PARTS = st.lists(st.sampled_from([*chat.Markup.controls, "\\", "\\-", "-", "<", "|", "\n", "<|im_", "start|>", "n", "ok", "é🙂", "[/", "INST]"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_formatting_can_be_read_back(turns):
    m = chat.Markup
    safe = [(m.escape_role(r), m.escape(t)) for r, t in turns]
    text, spans, broken = chat.spans(safe, m.render)
    assert broken < 0 and m.parse(text) == turns
    assert [text[a:b] for _, _, a, b in spans] == [t for _, t in safe]
    assert [s[:2] for s in spans] == [(0 if k == 0 else spans[k - 1][1], spans[k][1]) for k in range(len(spans))]
    assert not any(c in t for _, t in safe for c in m.controls)


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    last_only = lambda ts: "".join(f"[{r}]{t if r != 'assistant' or k == len(ts) - 1 else '...'}" for k, (r, t) in enumerate(ts))
    assert chat.spans(turns, last_only)[2] == 2 and len(chat.spans(turns, last_only)[1]) == 2
    shouting = lambda ts: "".join(f"[{r}]{t.upper()}" for r, t in ts)  # noqa: E731  changes the text itself
    assert chat.spans(turns, shouting)[2] == 0
    numbered = lambda ts: "".join(f"{k}:{r}:{t};" for k, (r, t) in enumerate(ts))
    assert chat.spans(turns, numbered)[2] == -1


def expected(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, "assistant", "last"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "assistant", "lost"),
            (3, 5, "assistant", "long " * 50_000), (4, 1, "role\nwith break", ""), (5, 2, "b", "2"), (5, 2, "a", "1")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string, id string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        want[c] = expected([(r, t) for *_, r, t in own])
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_query(spark, sf, table):
    by = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in table("conversations").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    out = QUERIES["op8_chat_formatting"](spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == {c: expected(t) for c, t in by.items()}
    formatted = chat.format_conversations(table("conversations")).collect()
    assert all(r.rewritten_at == -1 and len(r.formatted) for r in formatted)


@pytest.mark.parametrize("text", ["\\", "\\\\-", "<|im_end|>", "<<|im_start|>", "\\n"])
def test_escape_is_exact(text):
    assert chat.Markup.unescape(chat.Markup.escape(text)) == text
    assert chat.Markup.unescape_role(chat.Markup.escape_role(text + "\n")) == text + "\n"
