import json

from pyspark.sql import functions as F

from bookflow.llm import chat_format as chat
from bookflow.llm.chat_format import END, op12_chat_format

SAYINGS = ["hello", "", None, r"\### Assistant: </turn> ok", "<turn user>\nno</turn>\n", r"<\turn <\\/turn> \\ <turnip", "a\n\nb  \U0001f600 é", "</turn", "$1 \\1 (x)"]


def records(spark, rows):
    """rows: (key, place, record), with columns whose names clash."""
    full = [(k, p, r if r is None or isinstance(r, str) else json.dumps(r), "x", 1) for k, p, r in rows]
    return spark.createDataFrame(full, "conv long, place int, record string, formatted string, mask int")


def read(df):
    made = chat.format_chats(df, "conv", ["place"])
    return {r.conv: r for r in made.select("*", chat.read_back(F.col("formatted"), F.col("mask")).alias("back")).collect()}


def test_layouts(spark):
    talk = [("system", "be kind"), ("user", "why?"), ("assistant", "so")]
    asked = {
        1: {"messages": [{"role": r, "content": t} for r, t in talk], "id": {"messages": 3}},
        2: {"conversations": [{"from": f, "value": t} for f, t in zip(("system", "human", "gpt"), [t for _, t in talk])], "score": 0.5},
        3: {"instruction": "why?", "input": None, "output": "so", "system": "be kind"},
        4: {"prompt": "why?", "completion": "so", "system": "be kind", "meta": [{"prompt": 1}]},
        5: {"system": "be kind", "prompt": "why?", "response": "so"},
        6: {"system": "be kind", "prompt": "why?", "chosen": "so", "rejected": "no"},
        7: {"system": "be kind", "question": "why?", "answer": "so"},
        8: {"messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": [{"type": "text", "text": "wh"}, {"type": "text", "text": "y?"}]}, {"role": "assistant", "content": "so"}]},
    }
    names = {1: "messages", 2: "from_value", 3: "instruction", 4: "completion", 5: "response", 6: "preference", 7: "question", 8: "parts"}
    got = read(records(spark, [(k, 0, r) for k, r in asked.items()]))
    for k in asked:
        assert [(t.role, t.text) for t in got[k].back] == talk and got[k].layouts == [names[k]] and got[k].n_unknown == 0, k
        assert [t.masked for t in got[k].back] == [None, None, "so"]
    assert len({r.formatted for r in got.values()}) == 1
    more = read(records(spark, [(1, 0, {"instruction": "add", "input": "1 2", "output": "3"}), (2, 0, {"question": "q", "context": "c", "answer": "a"})]))
    assert [t.text for t in more[1].back] == ["add\n\n1 2", "3"] and [t.text for t in more[2].back] == ["c\n\nq", "a"]


def test_fingerprints(spark):
    rows = [{"a": 1, "b": {"c": [1, {"d": None}], "e.f": 2}}, {"b": {"e.f": 0, "c": [{"d": "x"}]}, "a": "y"}, {"a": 1}]
    df = records(spark, [(i, 0, r) for i, r in enumerate(rows)]).withColumn("v", F.parse_json("record"))
    got = [r.p for r in df.orderBy("conv").select(chat.field_paths(F.col("v")).alias("p")).collect()]
    assert got[0] == got[1] == sorted(["a", "b", "b.c", "b.c[].d", "b.e\\.f"]) and got[2] == ["a"]


def test_turns_round_trip(spark):
    roles = ["user", "assistant", "system", "to>ol\\g", "", None]
    rows = [(k, i, {"role": roles[(i + k) % 6], "text": t}) for k in range(6) for i, t in enumerate(SAYINGS)]
    got = read(records(spark, rows[::-1]))
    for k in range(6):
        want = [(roles[(i + k) % 6] or "", t or "") for i, t in enumerate(SAYINGS)]
        assert [(t.role, t.text) for t in got[k].back] == want
        assert [t.masked for t in got[k].back] == [t if r == "assistant" else None for r, t in want]
        text, at = got[k].formatted, 0
        assert text.count(END) == len(want) == got[k].n_turns and text.count("<turn ") == len(want)
        under = []
        for run in got[k].mask:
            under += [text[at : at + run.chars]] if run.loss else []
            at += run.chars
        assert at == len(text) and len(under) == sum(r == "assistant" for r, _ in want)


def test_odd_rows(spark):
    turn = {"role": "user", "text": "x", "turn": 5, "conv": {"role": "y"}}
    rows = [(1, 0, turn), (1, 0, turn), (None, 0, turn), (2, 0, None), (3, 0, "no json {"), (3, 1, {"strange": 1}), (3, 2, turn), (4, 0, [1, 2]), (5, 0, {"messages": []}), (6, None, {"role": "assistant", "text": "z " * 300_000}), (6, 1, turn), (7, 0, "")]
    got = read(records(spark, rows))
    assert [got[k].n_turns for k in (1, None, 2, 3, 4, 5, 6, 7)] == [2, 1, 0, 1, 0, 0, 2, 0]
    assert [got[k].n_unknown for k in (1, None, 2, 3, 4, 5, 7)] == [0, 0, 1, 2, 1, 1, 1]
    assert got[2].formatted == "" and got[2].back == [] and len(got[6].back[0].masked) == 600_000
    assert chat.format_chats(records(spark, rows).filter("conv > 99"), "conv", ["place"]).count() == 0


def test_query_reads_back_its_own_conversation(spark, sf):
    row = op12_chat_format(spark, sf).filter("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.formatted_chars == len(f"<turn user>\n<turn assistant>\n{END}{END}") + 2 * len(said) + 2
