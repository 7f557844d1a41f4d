"""Chat formatting: layouts, round trips and loss masks."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import chat

KIND = "conv_id long, turn long, role string, text string"
ODD = ["\\", "\\\\h", "###", "#####", "\\###", "\\h\\e\\c", "</turn>\n", "</turn</turn>", "### user: ", "a: b", "", " ", "é###\\é", "#", "<", "</turn", "\\\\\\", "x" * 3000 + "###" * 500, "\n", "\\n"]


def plain_escape(text, role=False):
    out = (text or "").replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e")
    return out.replace(":", "\\c") if role else out


def plain_row(conv_id, rows):
    order = sorted(rows, key=lambda r: tuple((x is not None, x.encode() if isinstance(x, str) else x) for x in r[1:]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in order)
    loss = "".join(r[3] or "" for r in order if r[2] == "assistant")
    size = sum(len(plain_escape(r[2], True)) + len(plain_escape(r[3])) + 14 for r in order)
    return (conv_id, len(rows), sha(lines), len(loss), sha(loss), size)


@pytest.fixture(scope="module")
def rows():
    out = [(c, t, ["user", "assistant", "system", "tool: ### x"][(c + t) % 4], ODD[(c * 3 + t) % len(ODD)]) for c in range(20) for t in range(c % 6 + 1)]
    out += [(30, 0, None, "a"), (30, 1, "assistant", None), (30, None, "user", "b"), (31, 2, "assistant", "x"), (31, 2, "assistant", "x"), (31, 2, "assistant", "w"), (31, 2, None, None)]
    return out + [(None, 0, "user", "n"), (None, None, None, None), (None, 1, "assistant", "m"), (32, 0, "assistant", "\\### Assistant: </turn> ok")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    for c in ("fingerprint", "layout", "turns", "head", "start", "messages", "id"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def test_query_equals_brute_force_and_sql(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.query(spark, str(tmp_path)).collect()
    own = [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    want = [plain_row(c, [r for r in rows + own if r[0] == c]) for c in {r[0] for r in rows + own}]
    key = lambda r: (r[0] is None, r[0])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(chat.SQL).fetchall(), key=key) == sorted(want, key=key)


def test_formatted_text_is_read_back_with_its_places(spark, rows):
    out = chat.chats(frame(spark, rows).select("conv_id", "turn", "role", "text"))
    got = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        own = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: tuple((v is not None, v) for v in x[1:]))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert all(r.formatted[s:].startswith("### ") for s in r.turn_starts) and len(r.turn_starts) == len(own) == len(r.loss_spans)
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [plain_escape(x[3]) if x[2] == "assistant" else "" for x in own]
        assert r.loss == [x[3] for x in own if x[2] == "assistant" and x[3]]
        assert r.formatted.count("###") == r.formatted.count("</turn>") == len(own)


RECORDS = {
    "messages": ({"id": 3, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
    "from and value": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a: b"}]}, [("user", "q"), ("assistant", "a: b")]),
    "instruction": ({"instruction": "do", "input": "x", "output": "###", "system": "s"}, [("system", "s"), ("user", "do\n\nx"), ("assistant", "###")]),
    "prompt and response": ({"response": "r", "prompt": "p"}, [("user", "p"), ("assistant", "r")]),
    "prompt and completion": ({"completion": "c", "prompt": "p", "source": "web"}, [("user", "p"), ("assistant", "c")]),
    "question and answer": ({"question": "?", "answer": "!", "context": "c"}, [("user", "c\n\n?"), ("assistant", "!")]),
    "query with history": ({"query": "q", "answer": "a", "history": [["u", "v"], ["w", "x"]]}, [("user", "u"), ("assistant", "v"), ("user", "w"), ("assistant", "x"), ("user", "q"), ("assistant", "a")]),
}


def test_json_records_of_many_layouts(spark):
    rows = [(i, json.dumps(record)) for i, (record, _) in enumerate(RECORDS.values())]
    odd = ["no json", "[1, 2]", None, "{}", '{"prompt": "p", "response": null}', '{"prompt": "p", "answer": "a"}', '{"messages": "text"}', '{"query": "q", "answer": "a", "history": []}']
    rows += [(100 + i, x) for i, x in enumerate(odd)] + [(200, '{"conv_id": 9, "turn": 1, "role": "r", "text": "t"}')]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    found = {r.conv_id: r for r in chat.fingerprinted(df, json_col="record").collect() if r.conv_id is not None}
    for i, (name, (_, want)) in enumerate(RECORDS.items()):
        assert found[i].layout == name and [(t.role, t.text) for t in found[i].turns] == want
    assert [found[100 + i].layout for i in range(8)] == [None] * 7 + ["query with history"]
    assert [(t.role, t.text) for t in found[107].turns] == [("user", "q"), ("assistant", "a")]
    assert (found[9].layout, found[9].turns[0].turn) == ("turn rows", 1)
    out = {r.conv_id: r.t for r in chat.chats(df, json_col="record").select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert len(out) == len(RECORDS) + 2
    assert [(t.role, t.text) for t in out[2]] == RECORDS["instruction"][1]


def test_paths_are_nested(spark):
    text = '{"a b": {"c": [[1]], "d": {"e": null}}, "x": [{"y": [true], "z": 1.5}, {"w": "t"}]}'
    got = spark.createDataFrame([(text,)], "r string").select(chat._Json("r").paths()).first()[0]
    assert got == sorted(["a b", "a b.c", "a b.c[]", "a b.c[][]", "a b.d", "x", "x[]", "x[].w", "x[].y", "x[].y[]", "x[].z"])


def test_typed_columns_have_the_same_fingerprints(spark):
    kind = "id long, messages array<struct<role:string,content:string>>, note string"
    df = spark.createDataFrame([(1, [("user", "u"), ("assistant", None)], None), (2, [("user", None)], None), (3, None, None), (4, [("user", "x")], "n")], kind)
    got = {r.conv_id: r for r in chat.fingerprinted(df, "id").collect()}
    assert [got[i].layout for i in (1, 2, 3, 4)] == ["messages", "messages", None, None]
    as_json = df.select("id", F.to_json(F.struct("id", "messages", "note")).alias("j"))
    same = {r.conv_id: r.fingerprint for r in chat.fingerprinted(as_json, "id", "j").collect()}
    assert all(same[i] == got[i].fingerprint for i in got)
    assert {r.conv_id for r in chat.chats(df, "id").collect()} == {1, 2}


def test_no_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert chat.chats(empty).count() == 0
    assert chat.chats(spark.createDataFrame([], "conv_id long, j string"), json_col="j").count() == 0
