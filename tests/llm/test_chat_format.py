import json

import pytest
from helpers import LONG
from pyspark.sql import functions as F

from loanscope.llm import chat_format as chat
from loanscope.llm.chat_format import Layout, Template

TRAPS = ["", "\\", "\\\\", "<|im_end|>\n", "a<|im_sep|>b", "[[INST]]", "<<SYS>><</SYS>>", "</s>[INST] ok [/INST]", "<s", "\\<s>", "<\\s>",
         "é<|im_start|>user\n😀", "$1 \\$ {x}", "line\r\nline\0", "<|endoftext|>" * 3, LONG]


def test_escape_round_trip_leaves_no_control_string(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRAPS)], "i int, t string")
    rows = df.select("i", chat.escape(F.col("t")).alias("safe"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert r.back == TRAPS[r.i] and not any(c in r.safe for c in Template().control)


RECORDS = [
    {"conv_id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "source": "a"},
    {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "t"}]},
    {"conv_id": 3, "prompt": "p", "response": "r"},
    {"conv_id": 4, "prompt": "p", "completion": "c", "system": "s"},
    {"conv_id": 5, "instruction": "i", "input": "x", "output": "o"},
    {"conv_id": 6, "instruction": "i", "output": "o", "meta": {"lang": "en"}},
    {"conv_id": 7, "messages": []},
    {"conv_id": 8, "prompt": "alone"},
    {"conv_id": 9},
    {"conv_id": 10, "prompt": "p", "response": "r", "messages": [{"role": "user", "content": "both"}]},
    {"conv_id": 3, "prompt": "p", "response": "r"},
    {"conv_id": None, "messages": [{"role": None, "content": "no role"}]},
]
TURNS = {
    1: ("messages", [("user", "hi"), ("assistant", "")]),
    2: ("from_value", [("user", "q"), ("assistant", "r"), ("tool", "t")]),
    3: ("prompt_response", [("user", "p"), ("assistant", "r")]),
    4: ("prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    5: ("instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    6: ("instruction", [("user", "i"), ("assistant", "o")]),
    7: ("messages", []),
    8: (None, None), 9: (None, None), 10: (None, None),
    None: ("messages", [("", "no role")]),
}


def test_mixed_layouts_of_one_file(spark, tmp_path):
    (tmp_path / "records.json").write_text("\n".join(json.dumps(r) for r in RECORDS))
    made = chat.format_chats(spark.read.json(str(tmp_path / "records.json")))
    rows = made.withColumns({"back": chat.read_turns(F.col("formatted")), "learnt": chat.read_loss(F.col("formatted"), F.col("loss"))}).collect()
    assert len(rows) == len(RECORDS)
    for r in rows:
        layout, turns = TURNS[r.id]
        assert r.layout == layout and (r.turns is None) == (turns is None)
        if turns is not None:
            assert [tuple(t) for t in r.turns] == [tuple(t) for t in r.back] == turns
            assert r.learnt == [t for role, t in turns if role == "assistant"]
            raw = r.formatted.encode()
            assert [raw[s.start:s.start + s.length].decode() for s in r.loss] == r.learnt        # nothing to escape in these
        else:
            assert r.formatted is None and r.loss is None


def test_fingerprint_depends_on_paths_alone(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in RECORDS))
    records = spark.read.json(str(tmp_path / "r.json"))
    prints = {r.conv_id: r.p for r in records.select("conv_id", chat.fingerprint(records).alias("p")).collect()}
    assert prints[8] != prints[9] and prints[3] != prints[4] and prints[5] != prints[6]
    wider = records.withColumns({"fingerprint": F.lit("x"), "turns": F.lit(1), "layout": F.lit(2)})
    assert prints == {r.conv_id: r.p for r in wider.select("conv_id", chat.fingerprint(wider).alias("p")).collect()}
    assert {r.id: r.layout for r in chat.canonical(wider).collect()} == {i: t[0] for i, t in TURNS.items()}


def test_own_layout_and_template(spark):
    records = spark.createDataFrame([(1, "q?", "a!"), (2, None, "a")], "conv_id long, question string, answer string")
    layout = Layout("qa", ("question", "answer"), fields=(("user", ("question",)), ("assistant", ("answer",))))
    template = Template("[INST]", "[SEP]", "</s>", ("[INST]", "[SEP]", "</s>"))
    made = chat.format_chats(records, [layout], template).orderBy("id").collect()
    assert made[0].formatted == "[INST]user[SEP]q?</s>[INST]assistant[SEP]a!</s>" and made[1].layout is None
    with pytest.raises(ValueError):
        Template(control=("x",))
    with pytest.raises(ValueError):
        Template(start="BEGIN")


def rows_of(spark, rows):
    schema = "conv_id long, turn long, role string, text string, rows int, messages string, layout int"
    return spark.createDataFrame([(*r, 1, "m", 2) for r in rows], schema)


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", TRAPS[5]), (1, 1, "user", None), (2, 1, "system", "s"), (2, 2, "user", "u"), (2, 3, "assistant", "a"),
            (3, 1, "system", "s"), (3, 2, "user", "u"), (None, 1, "user", "n"), (None, 1, "user", "n"), (4, None, None, None),
            (5, 1, "assistant", LONG), (5, 1, "assistant", "a tie"), (6, 1, "x\n\\", "<s>"), (7, 1, "system", "s"), (7, 2, "other", "o")]
    made = chat.format_chats(chat.as_records(rows_of(spark, rows)))
    got = {r.id: r for r in made.withColumn("back", chat.read_turns(F.col("formatted"))).collect()}
    turns = {i: [tuple(t) for t in r.back] for i, r in got.items()}
    assert turns == {1: [("user", ""), ("assistant", TRAPS[5])], 2: [("system", "s"), ("user", "u"), ("assistant", "a")],
                     3: [("system", "s"), ("user", "u")], None: [("user", "n"), ("user", "n")], 4: [("", "")],
                     5: [("assistant", "a tie"), ("assistant", LONG)], 6: [("x\n\\", "<s>")], 7: [("system", "s"), ("other", "o")]}
    assert [got[i].layout for i in (1, 2, 3, 7)] == ["prompt_response", "prompt_response", "from_value", "messages"]
    assert chat.format_chats(chat.as_records(rows_of(spark, []))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.format_chats(chat.as_records(rows_of(spark, [(1, 1, "a", "b")])))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
