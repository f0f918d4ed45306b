import json

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "\\", "\\\\<s>", "a\\<|b", "<<SYS>> x <</SYS>>", "", None, "line\nline", "<", "[", "<|", "é😀<|im_start|>", "\\n"]


def test_escape_is_reversible_and_hides_control_strings(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    for t, e, back in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t")))).collect():
        assert back == t
        assert not any(c in e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_layouts_and_path_hashes(spark):
    df = spark.createDataFrame([('{"b":[{"y":1,"x":null}],"a":"t"}',), ("[1]",), ("no json",), ('{"messages":[]}',), (None,)], "r string")
    assert [r[0] for r in df.select(chat.json_layout(F.col("r"))).collect()] == ["OBJECT<a, b: ARRAY<OBJECT<x, y>>>", "ARRAY<>", None, "OBJECT<messages: ARRAY<>>", None]
    assert spark.sql("select xxhash64('messages[].role')").first()[0] == chat.fingerprint("messages[].role")
    record = {"messages": [{"role": "user", "content": None, "x": 1}, {"role": "user"}], "prompt": None, "id": 3}
    got = spark.createDataFrame([(json.dumps(record),)], "r string").select(chat.path_hashes(F.try_parse_json("r"))).first()[0]
    assert set(got) == {chat.fingerprint(p) for p in ("messages", "messages[].role", "prompt")}


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"role": "user", "content": "hi"}, [("user", "hi")]),
        ({"from": "human", "value": "hi"}, [("user", "hi")]),
        ({"messages": [{"role": "system", "content": "s"}, {"role": "assistant", "content": None}]}, [("system", "s"), ("assistant", "")]),
        ({"messages": []}, []),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"unknown": 1}, None),
        ({"role": "Assistant ", "content": "hi", "name": "n", "meta": {"a": [1]}}, [("assistant", "hi")]),
        ({"id": 1, "messages": [{"role": "HUMAN", "content": "a", "weight": 0}], "prompt": "p"}, [("user", "a")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "user"}]}, None),
        ({"role": "critic", "text": 5}, [("critic", "5")]),
        ({"instruction": "i", "output": "o", "response": "r"}, [("user", "i"), ("assistant", "o")]),
        ([1], None),
    ],
)
def test_layouts(spark, record, turns):
    df = spark.createDataFrame([(json.dumps(record),)], "r string")
    got = chat.canonical(df, "r").first()["turns"]
    assert got == turns if turns is None else [tuple(t) for t in got] == turns


def test_typed_records_choose_by_their_columns(spark):
    df = spark.sql("select named_struct('messages', array(named_struct('content', 'a', 'role', 'Bot', 'x', 1)), 'id', 7) as rec, 1 as turns union all select null, 2")
    out = chat.canonical(df, "rec")
    assert out.columns == ["rec", "turns", "turns_"]
    assert [r["turns_"] and [tuple(t) for t in r["turns_"]] for r in out.orderBy("turns").collect()] == [[("assistant", "a")], None]
    odd = chat.canonical(spark.sql("select named_struct('said', 'a', 'by', named_struct('who', 'b')) as rec"), "rec")
    assert [tuple(r) for r in chat.unmapped(odd, "rec").collect()] == [("by, by.who, said", 1)]


def test_hashes_choose_the_mapping_of_typed_records(spark, monkeypatch):
    df = spark.sql("select named_struct('role', 'user', 'text', 'a', 'prompt', 'p', 'answer', interval 1 day) as rec union all select null union all select named_struct('role', null, 'text', null, 'prompt', null, 'answer', null)")
    turns = lambda: sorted(([tuple(t) for t in r["turns"]] if r["turns"] else None for r in chat.canonical(df, "rec").collect()), key=repr)
    assert turns() == [None, [("", "")], [("user", "a")]]
    only = {chat.fingerprint("prompt"), chat.fingerprint("answer")}
    monkeypatch.setattr(chat, "path_hashes", lambda record, mappings, held=chat.path_hashes: F.filter(held(record, mappings), lambda h: h.isin(only)))
    assert [("user", "a")] not in turns() and any(t and t[0] == ("user", "p") for t in turns())
    monkeypatch.setattr(chat, "path_hashes", lambda record, mappings: F.array().cast("array<bigint>"))
    assert turns() == [None] * 3


def test_records_without_a_mapping_are_counted(spark):
    rows = [(1, 0, '{"role":"user","content":"a","name":"x"}'), (1, 1, '{"said":"b"}'), (1, 2, None), (2, 0, "no json"), (3, 0, '{"messages":[]}'), (None, 0, '{"said":"c"}'), (None, 1, '{"prompt":"p","answer":"q"}')]
    df = chat.canonical(spark.createDataFrame(rows, "conv bigint, turn bigint, r string"), "r")
    got = sorted(((r["conv"], r["formatted"], r["unmapped"]) for r in chat.format_turns(df, "conv", "turns", ["turn"]).collect()), key=repr)
    one = "<|turn|>user<|text|>a<|end|>\n"
    assert got == sorted([(1, one, 2), (2, "", 1), (3, "", 0), (None, "", 1), (None, one.replace(">a<", ">p<") + "<|turn|>assistant<|text|>q<|end|>\n", 0)], key=repr)
    assert sorted(map(tuple, chat.unmapped(df, "r").collect()), key=repr) == sorted([("OBJECT<said>", 2), (None, 2)], key=repr)


def test_long_conversations_and_clashing_names(spark):
    text = "a<|b\\ " * 100_000
    df = spark.createDataFrame([(1, n, "assistant", text) for n in range(3)], "id bigint, n int, role string, text string").select("id", "n", F.struct("role", "text").alias("head"), F.lit(1).alias("lost"), F.lit(2).alias("t"))
    row = chat.format_turns(chat.canonical(df, "head"), "id", "turns", ["n"]).select(chat.parse(F.col("formatted")).alias("back"), chat.learned_text("segments").alias("learned")).first()
    assert [t["text"] for t in row["back"]] == [text] * 3 and row["learned"] == text * 3


def test_round_trip(spark):
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(ODD)] + [(2, 0, None, "only"), (None, 3, "user", "x"), (None, 1, "user", "y"), (2, 0, None, "only"), (3, None, "assistant", "late"), (3, 0, "we<|ird\n", "")]
    df = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string").select("conv", "turn", F.struct("role", "text").alias("rec"))
    out = chat.format_turns(chat.canonical(df, "rec"), "conv", "turns", ["turn"])
    alone = out.where("conv is null").select(chat.parse(F.col("formatted")).alias("back")).collect()
    assert sorted(tuple(t) for r in alone for t in r["back"]) == [("user", "x"), ("user", "y")] and len(alone) == 2
    got = {r["conv"]: r for r in out.select("*", chat.parse(F.col("formatted")).alias("back"), chat.learned_text("segments").alias("learned")).collect()}
    for conv in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [tuple(t) for t in got[conv]["back"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv]["learned"] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        text = got[conv]["formatted"]
        assert [text[s["start"] : s["end"]] for s in got[conv]["loss_spans"]] == [s["text"] for s in got[conv]["segments"] if s["loss"]]


def test_empty(spark):
    df = spark.createDataFrame([], "conv bigint, turn bigint, r string")
    assert chat.format_turns(chat.canonical(df, "r"), "conv", "turns", ["turn"]).count() == 0
