"""Chat formatting: round trips of every control string, each layout, odd rows, and the loss mask."""

import hashlib
import json

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penstroke.llm import chat

ODD = ["", "plain", "</s>[INST] ok [/INST]", "[", "<", "</s", "<\\/s>", "<\\\\/s>", "[\\INST] [\\\\/INST]", "a[/INST", "[[INST]]", "<<s>>", " [/INST]", "[ROLE]x[/ROLE]", "</s></s>", "\\", "\\\\<s>", "tab\t\nline\r\n", "é🙂<s>", "[SYS] [/SYS]</s>", "<unk>", "</S>", "$1 \\1"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_of(conv, turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)


def test_every_control_string_in_every_role(spark):
    roles = ["user", "assistant", "system", "tool", "", "[ROLE]", "</s>[/ROLE]", "assistant\\"]
    rows = [(k, j, role, text) for k, role in enumerate(roles) for j, text in enumerate(ODD)]
    out = chat.read_back(chat.pieces(chat.turns(chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3))))).collect()
    assert {tuple(r)[:5] for r in out} == {row_of(k, [(role, t) for t in ODD]) for k, role in enumerate(roles)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "ROLE]", " ", "x", "unk>"]), max_size=12).map("".join))
def test_escapes_are_undone(text):
    import re

    first, rest = chat._sites(chat.TEMPLATE)
    escaped = re.sub(rf"({first}\\*+)(?={rest})", r"\1\\", text)
    assert chat.unescaped(escaped) == text
    assert not any(c in escaped for c in chat.TEMPLATE.controls())
    assert chat.parsed(f"[INST] {escaped} [/INST]{escaped}</s>[ROLE]{escaped}[/ROLE]{escaped}</s>") == [("user", text), ("assistant", text), (text, text)]


U, A, S = ("user", "hi"), ("assistant", "there"), ("system", "be")
RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "there"}]}, [U, A]),
    ({"messages": [{"content": "be", "role": "system"}, {"content": None, "role": "user"}, {"content": "there", "role": "Assistant"}]}, [S, ("user", ""), ("Assistant", "there")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}, {"role": "assistant", "content": [{"type": "text", "text": "there"}]}]}, [("user", "h\n\ni"), A]),
    ({"system": "be", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "there"}]}, [S, U, A]),
    ({"prompt": "hi", "completion": "there"}, [U, A]),
    ({"prompt": "hi", "response": None, "system": None}, [U, ("assistant", "")]),
    ({"question": "hi", "answer": "there"}, [U, A]),
    ({"question": "q", "answer": "there", "context": "c"}, [("user", "c\n\nq"), A]),
    ({"instruction": "hi", "input": "", "output": "there"}, [U, A]),
    ({"instruction": "do", "input": "this", "output": 12, "system": "be", "history": [["hi", "there"], ["a"]]}, [S, U, A, ("user", "a"), ("assistant", ""), ("user", "do\n\nthis"), ("assistant", "12")]),
    ({"turn": 3, "role": "user", "text": "hi"}, [U]),
]


def test_layouts(spark):
    rows = [(k, json.dumps(record)) for k, (record, _) in enumerate(RECORDS)] + [(50, None), (51, "not json"), (52, '{"prompt": "x"}'), (53, '{"prompt": {"a": 1}, "completion": "x"}'), (54, "[]")]
    records = chat.json_records(spark.createDataFrame(rows, "conv_id long, json string"))
    out = {r.conv_id: tuple(r)[:5] for r in chat.read_back(chat.pieces(chat.turns(records))).collect()}
    assert out == {k: row_of(k, turns) for k, (_, turns) in enumerate(RECORDS)}
    assert {(r["shape"], r.n) for r in chat.unknown_shapes(records).collect()} == {(None, 2), ("OBJECT<prompt: >", 1), ("OBJECT<completion: , prompt: OBJECT<a: >>", 1), ("ARRAY<>", 1)}


def test_records_apart_and_rows_together(spark):
    """Rows of a conv_id are one conversation, records of one are several, and rows without one are single."""
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "user", "z"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "a"), (None, 0, "user", "a"), (2, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS record", "'x' AS alone", "2 AS place", "3 AS formatted")
    records = chat.turn_records(table.repartition(4)).unionByName(chat.json_records(spark.createDataFrame([(1, json.dumps(RECORDS[4][0]))] * 2, "conv_id long, json string")))
    out = sorted((tuple(r)[:5] for r in chat.read_back(chat.pieces(chat.turns(records))).collect()), key=str)
    one = row_of(1, [("user", "z"), ("user", "a"), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")])
    assert out == sorted([one, row_of(1, [U, A]), row_of(1, [U, A]), row_of(None, [("user", "a")]), row_of(None, [("user", "a")]), row_of(2, [("", "")])], key=str)


def test_empty_table(spark):
    assert chat.read_back(chat.pieces(chat.turns(chat.turn_records(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))).count() == 0


def test_joined_conversations(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(ODD)]
    got = chat.joined(chat.pieces(chat.turns(chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).collect()[0]
    assert chat.parsed(got.formatted) == [(r, t) for _, _, r, t in rows]
    assert [chat.unescaped(got.formatted[s.start : s.end]) for s in got.loss_spans] == [t for _, _, r, t in rows if r == "assistant" and t]


def test_not_in_the_template():
    with pytest.raises(ValueError, match="character 9"):
        chat.parsed("hello</s> [INST]")


def test_sql_on_odd_rows(spark):
    rows = [(k % 3, k, role, t) for k, (role, t) in enumerate((r, t) for r in ("user", "assistant", "system", "tool", None, "[ROLE]<s>") for t in [*ODD, None])]
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    connection = duckdb.connect()
    connection.register("conversations", frame)
    records = chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).unionByName(chat.json_records(spark.createDataFrame([(-7, chat.PLANTED)], "conv_id long, json string")))
    got = {tuple(r) for r in chat.read_back(chat.pieces(chat.turns(records))).collect()}
    assert got == set(connection.sql(f"SELECT {', '.join(c for c in 'conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars'.split())} FROM ({chat.ORACLE})").fetchall())


def test_control_strings_come_from_the_template(spark):
    own = chat.Template({"user": ("<|u|>", "<|e|>"), "assistant": ("<|a|>", "<|e|>")}, ("<|r|>", "<|:|>", "<|e|>"), ())
    rows = [(1, 0, "user", "<|e|> </s>"), (1, 1, "assistant", "<|a|>"), (1, 2, "system", "<|r|>")]
    pieces = chat.pieces(chat.turns(chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), own)
    assert tuple(chat.read_back(pieces, own).collect()[0])[:5] == row_of(1, [(r, t) for _, _, r, t in rows])
    assert pieces.where(F.col("formatted").contains("</s>")).count() == 1
