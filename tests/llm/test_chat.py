import hashlib

import duckdb

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PIECES = st.sampled_from([*chat.CONTROL, chat.MARK, "<", "|", "s>", "[", "/INST]", "\\", "é", "\n", "user", "a b", "🙂"])


@given(st.lists(PIECES, max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


@given(st.lists(PIECES, max_size=4).map("".join), st.lists(PIECES, max_size=8).map("".join))
def test_turns_read_back(role, text):
    block, a, b = chat.turn_block(role, text)
    assert chat.read_blocks(block + block) == [(role, text)] * 2
    assert chat.unescape(block[a:b]) == text


def windows_of(turns, budget, history):
    now = chat._Conversation(1, budget, history, lambda t: len(t))
    out = [w for role, text in turns for w in now.add(role, text)]
    return [*out, now.close()]


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text("ab<|>\x1a", max_size=40)), min_size=1, max_size=12), st.integers(60, 400), st.integers(0, 200))
def test_windows_hold_every_turn_once_within_budget(turns, budget, history):
    found = windows_of(turns, budget, history)
    back, targets = [], ""
    for w in found:
        _, _, text, used, _, old, new, system, over, starts, ends = w
        blocks = chat.read_blocks(text)
        assert len(blocks) == old + new and used == len(text)
        assert over == (used > budget) and (not over or new == 1)
        if system:
            assert blocks[0] == turns[0]
        back += blocks[old:]
        targets += "".join(chat.unescape(text[a:b]) for a, b in zip(starts, ends))
    assert back == turns
    assert targets == "".join(t for r, t in turns if r == "assistant")


def test_query_shape_on_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (5, 2, "assistant", "b"), (5, 1, "user", None), (5, 1, "user", None), (6, 0, "assistant", "long " * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as window", "1 as formatted")
    got = {r["conv_id"]: r for r in chat.read_back(chat.chat_windows(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {None: 2, 5: 3, 6: 1}
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\nassistant\nb\n").hexdigest()
    assert got[6]["loss_chars"] == 25_000
    assert chat.read_back(chat.chat_windows(turns.where("false"))).count() == 0


def test_digests_against_sql(spark):
    """All columns but the length of the format, over all conversations and one that is full of control strings."""
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    result = con.execute(chat._SQL)
    names = [d[0] for d in result.description]
    want = {r[0]: r for r in result.fetchall()}
    rows = chat.op2_chat_format(spark, "/root/testdata/sf0.001").collect()
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in rows} == want and len(rows) == len(want) > 20
    assert all(r["formatted_chars"] > r["loss_chars"] for r in rows)


def test_one_very_long_conversation(spark):
    """Thousands of turns in one conversation, repeated turn numbers, null ids and a turn above the budget."""
    turns = [(1, i // 2, ("user", "assistant")[i % 2], f"turn {i} " * (i % 40)) for i in range(6000)]
    turns += [(1, 7000, "assistant", "long " * 20_000), (None, 0, "user", None), (None, 1, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.chat_windows(df)).collect()}
    ordered = sorted((t for t in turns if t[0] == 1), key=lambda t: (t[1], t[2], t[3]))
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in ordered)
    assert got[1]["n_turns"] == 6001 and got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in ordered if r == "assistant").encode()).hexdigest()
    assert got[None]["n_turns"] == 2
