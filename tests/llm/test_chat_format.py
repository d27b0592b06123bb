import hashlib

import pytest

from tracegrain.llm import chat_format

NASTY = ["\\### Assistant: </turn> ok", "<join>", "a\\lb\\b<turn:user>", "", "</turn>\n<turn:assistant>x", "é日🎉\n\n", "\\", "<", None]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def back(spark, rows):
    parsed = chat_format.parse_conversations(chat_format.format_conversations(turns(spark, rows)))
    return {r.conv_id: r for r in parsed.collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, ["user", "assistant", "<r>\\"][i % 3], t) for i, t in enumerate(NASTY)]
    got = back(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r, t or "") for _, _, r, t in rows]
    assert got.loss_texts == [t or "" for _, _, r, t in rows if r == "assistant"]


def test_adjacent_turns_of_a_role_share_a_block_and_come_back_apart(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    row = chat_format.format_conversations(turns(spark, rows)).first()
    assert row.formatted == "<turn:user>a<join>b</turn>\n<turn:assistant>c<join>d</turn>\n<turn:user>e</turn>\n"
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == ["c", "d"]
    assert [t.text for t in back(spark, rows)[1].turns] == list("abcde")


def test_long_conversation_offsets(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"t{i}" * (i % 5)) for i in range(700)]
    row = chat_format.format_conversations(turns(spark, rows)).first()
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == [t for _, _, r, t in rows if r == "assistant"]


def test_digest(spark):
    rows = [(1, 1, "assistant", "hé"), (1, 0, "user", None), (2, 0, "user", "x")]
    got = {r.conv_id: r for r in chat_format.digest(chat_format.parse_conversations(chat_format.format_conversations(turns(spark, rows)))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\nhé\n".encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars) == (2, 2, 0)
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_ties_nulls_repeats_and_extra_columns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, "n"), (1, 0, "user", "a"), (None, 0, "user", "z")]
    df = turns(spark, rows).selectExpr("*", "1 AS _turns", "2 AS formatted")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.parse_conversations(chat_format.format_conversations(df)).collect()}
    assert got == {1: [("", "n"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "z")]}


def test_empty_table(spark):
    assert chat_format.format_conversations(turns(spark, [])).count() == 0


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None])
def test_escape_leaves_no_mark(spark, text):
    from pyspark.sql import functions as F

    row = spark.range(1).select(chat_format.escape(F.lit(text)).alias("e"), chat_format.unescape(chat_format.escape(F.lit(text))).alias("u")).first()
    assert "<" not in row.e and row.u == text


def test_spans_over_pieces(spark):
    from pyspark.sql import functions as F

    from tracegrain.llm import arrays

    text = "é🎉\n\r x" * 200
    spans = [(0, 0), (0, 1), (255, 257), (256, 512), (511, 512), (3, 1200), (1200, 1200), (700, 700)]
    df = spark.createDataFrame([(text, s, e) for s, e in spans], "t string, s long, e long").withColumn("p", arrays.pieces(F.col("t")))
    assert [r.x for r in df.select(arrays.between(F.col("p"), F.col("s"), F.col("e")).alias("x")).collect()] == [text[s:e] for s, e in spans]
    assert spark.range(1).select(arrays.between(arrays.pieces(F.lit("")), F.lit(0), F.lit(0)).alias("x")).first().x == ""


def test_prefixes(spark):
    from pyspark.sql import functions as F

    from tracegrain.llm import arrays

    values = [(i * 7919) % 1000 for i in range(1030)]
    for rows in (values, values[:256], values[:1], []):
        df = spark.createDataFrame([(rows,)], "v array<long>")
        df = arrays.with_prefix(arrays.with_prefix(df, "sum", "v"), "most", "v", arrays.largest)
        got = df.first()
        assert got["sum"] == [sum(rows[:i]) for i in range(len(rows))]
        assert got["most"] == [max(rows[:i], default=0) for i in range(len(rows))]
