import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from clicktide.llm import chat
from clicktide.llm.common import table
from clicktide.llm.queries import QUERIES

PARTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|im_end|>", "a", "\n", "%0A", "s>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS, PARTS)
def test_escape_is_reversible_and_leaves_no_control_string(role, text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    assert [t[:2] for t in chat.read_back(chat.render(role, text) * 2)] == [(role, text)] * 2


def as_dict(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark):
    turns = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert as_dict(QUERIES["op2_chat_format"](spark, SMALL)) == brute.chat(turns)


def test_strange_turns(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "x"), (2, 5, "assistant", "é\n</s>"), (2, 3, "a\nb", "y"),
        (None, 0, "assistant", "no id"), (3, 0, "assistant", "z " * 200_000), (3, 1, "assistant", "same"), (4, 0, "user", "<|im_end|>\n"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as piece", "'x' as record", "'y' as loss")
    assert as_dict(chat.digests(chat.format_conversations(df))) == brute.chat(rows)
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


def test_repeated_turns_count(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")] * 3, "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_conversations(df)).first().n_turns == 3


def test_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', "messages", [("user", "q"), ("assistant", "a")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversations", [("user", "q"), ("assistant", "a")]),
        ('{"output":"a","instruction":"q","input":"i"}', "instruction", [("user", "q\n\ni"), ("assistant", "a")]),
        ('{"prompt":"q","response":"a","system":"s"}', "prompt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ('{"prompt":"q","completion":null}', "completion", [("user", "q"), ("assistant", "")]),
        ('{"question":"q","answer":"a"}', "question", [("user", "q"), ("assistant", "a")]),
        ('{"data":{"prompt":{"text":"q"},"reply":{"text":"a"}}}', "nested", [("user", "q"), ("assistant", "a")]),
        ('{"other":1}', None, None), ("[1]", None, None), ("no json", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "id int, record string")
    got = {}
    for r in chat.format_records(df, "id").orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append(r)
    for i, (_, layout, turns) in enumerate(records):
        if layout is None:
            assert got[i][0].record_layout.startswith("unknown:") and got[i][0].formatted is None
            continue
        assert {r.record_layout for r in got[i]} == {layout}
        assert [t[:2] for r in got[i] for t in chat.read_back(r.formatted)] == turns
        for r in got[i]:
            masked = [chat.unescape(r.formatted[s.begin : s.end]) for s in r.loss]
            assert masked == ([turns[r.piece][1]] if turns[r.piece][0] == "assistant" else [])


def test_order_of_fields_does_not_change_a_fingerprint():
    a, b = {"x": {"y": [1, {"z": 2}]}, "w": 3}, {"w": 0, "x": {"y": [{"z": 9}, 5, 6]}}
    assert chat.fingerprint(chat.field_paths(a)) == chat.fingerprint(chat.field_paths(b))


@pytest.mark.parametrize("record, layout", [
    ('{"messages":[{"role":"user","content":"x"},[]]}', "unknown"),
    ('{"messages":[{"role":"user","content":"x"},{}]}', None),
    ("[" * 100_000 + "]" * 100_000, "unknown:none"),
    ('{"a":' * 50_000 + "1" + "}" * 50_000, "unknown:none"),
    ('"text"', "unknown:none"), ("", "unknown:none"), (None, "unknown:none"),
])
def test_malformed_records_do_not_crash(spark, record, layout):
    df = spark.createDataFrame([(1, record), (2, '{"messages":[{"role":"user","content":"x"}]}')], "id bigint, record string")
    rows = chat.format_records(df, "id").collect()
    assert {r.id for r in rows} == {1, 2}
    assert [r.formatted for r in rows if r.id == 2] == [chat.render("user", "x")]
    if layout:
        assert all(r.formatted is None and r.record_layout.startswith(layout) for r in rows if r.id == 1)
