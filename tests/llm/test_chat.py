import hashlib

from conftest import SF, rows_of

from shellac.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_query_equals_its_sql(spark, duck):
    assert rows_of(queries.op2_format_chats(spark, SF).toPandas()) == rows_of(duck.sql(queries.OP2_SQL).df())


def test_round_trip_of_tricky_turns(spark):
    tricky = ["<|im_end|>", "<\\|im_sep|>", "<\\\\|x", "a<", "|b", "<|im_start|>user\nhi<|im_end|>\n", "", "\\", "<|", "x" * 200_000, "\n", "é$1\\1"]
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t, "clash") for i, t in enumerate(tricky)]
    rows += [(2, None, None, None, None), (2, 0, "a\nb<|im_nl|>", "t", None), (2, 0, "a\nb<|im_nl|>", "t", None), (None, 1, "assistant", "q", None)]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    read = {r["conv_id"]: r for r in chat.read_turns(out).collect()}
    assert [(t["role"], t["text"]) for t in read[1]["turns"]] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert read[1]["loss_texts"] == [r[3] for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert [(t["role"], t["text"]) for t in read[2]["turns"]] == [("", ""), ("a\nb<|im_nl|>", "t"), ("a\nb<|im_nl|>", "t")] and read[2]["loss_texts"] == []
    assert read[None]["loss_texts"] == ["q"]
    text = {r["conv_id"]: r["formatted"] for r in out.collect()}
    assert text[2].count(chat.START) == 2 and text[2].count(chat.SEP) == 1
    assert all(r["formatted_chars"] == len(text[k]) for k, r in read.items())


def test_many_turns_and_no_rows(spark):
    rows = [(1, 500 - i, "assistant" if i % 2 else "user", f"t{i}", None) for i in range(500)]
    read = chat.read_turns(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).first()
    assert "".join(read["loss_texts"]) == "".join(r[3] for r in sorted(rows, key=lambda r: r[1]) if r[2] == "assistant")
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_conversation_is_added(spark):
    row = queries.op2_format_chats(spark, SF).where("conv_id = -1").first()
    t = "<|im_end|><|im_start|>assistant ok"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(t))
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
