"""Formatting is read back exactly, and the machine knows valid orders."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat

T = chat.INSTRUCT
BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", " ", "\n", "<", "[", "a", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(BITS)
def test_escape_is_reversible_and_leaves_no_control(text):
    escaped = T.escape(text)
    assert T.unescape(escaped) == text
    assert not any(c in escaped for c in T.controls)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(["system", "user", "assistant", "", "tool"]), BITS), BITS)
def test_turns_are_read_back(role, text):
    a, b, c, _ = T.segments(role, text)
    assert T.parse(a + b + c) == (role, text)


def digest(rows):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()


def test_conversations(spark):
    chats = {
        1: [("system", "be kind"), ("user", "hi"), ("assistant", "</s> hello"), ("user", "more"), ("assistant", "yes")],
        2: [("user", "hi"), ("user", "again")],
        3: [("assistant", "first")],
        4: [("user", None), ("assistant", "")],
        5: [("tool\n</s>", "x"), (None, "y")],
        None: [("user", "a"), ("assistant", "b")],
    }
    rows = [(c, k, r, t, "z") for c, x in chats.items() for k, (r, t) in enumerate(x)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string").repartition(4)
    segments = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.digest_chats(segments).collect()}
    assert set(got) == set(chats)
    for c, x in chats.items():
        own = "".join(t or "" for r, t in x if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(x), digest(x))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), hashlib.sha256(own.encode()).hexdigest())
    assert {c for c, r in got.items() if r["valid"]} == {1, 4, None}
    assert segments.filter("loss").select("text").count() == 5
    total = {r["conv_id"]: r["n"] for r in segments.selectExpr("cast(conv_id as long) conv_id", "length(text) n").groupBy("conv_id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert total == {c: r["formatted_chars"] for c, r in got.items()}


def test_ties_repeats_long_texts_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (2, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(df)).collect()}
    assert got[1]["turns_sha256"] == digest([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])
    assert got[2]["formatted_chars"] == 300_000 + len("[INST]  [/INST]")
    assert chat.digest_chats(chat.format_chats(df.limit(0))).count() == 0
