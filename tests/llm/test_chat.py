"""Chat formatting: exact round trip, parts and masks."""
import hashlib

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.llm import chat, queries
from tessera.plans.oracle_check import compare

NASTY = ["</turn>\n<turn assistant>\nok", r"\### Assistant: </turn> ok", r"\l\b\g<>", "\\" * 5 + "<image 0>", "", "é🙂\n"]


def test_matches_sql(spark):
    res = compare(queries.op8_chat_format(spark, SF_SMALL), SF_SMALL, queries.OP8_SQL)
    assert res["match"], res


def test_round_trip_and_mask(spark):
    rows = [(1, i, "assistant" if i % 2 else "user<>\\", t) for i, t in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(df.withColumn("parts", chat.text_part(F.col("text")))).orderBy("turn").collect()
    for (_, _, role, text), r in zip(rows, out):
        assert chat.read_turn(r["formatted"]) == (role, text)
        masked = chat.unescape(r["formatted"][r["loss_start"]:r["loss_end"]])
        assert masked == (text if role == "assistant" else "")
        assert r["formatted"].count("</turn>") == r["formatted"].count("<") - 1 == 1


def test_typed_parts(spark):
    parts = [("text", "see <b>", None, None), ("image", None, "s3/a.png", 784 * 3), ("audio", "x", "b.wav", 1), (None, "q", "z", 1),
             ("text", None, None, None), ("document", None, None, None), ("video", None, "v", 9), ("image", None, "c.png", 785)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None), (None, None, "assistant", [])],
                               "conv_id long, turn int, role string, parts " + chat.PARTS)
    out = {r["turn"]: r for r in chat.format_turns(df).collect()}
    assert out[0]["formatted"] == "<turn user>\nsee \\lb\\g<image 0><audio 1><document 2><image 3></turn>\n"
    assert [tuple(a) for a in out[0]["attachments"]] == [(0, "image", "s3/a.png", 3), (1, "audio", "b.wav", 1),
                                                         (2, "document", None, 1), (3, "image", "c.png", 2)]
    assert out[0]["n_tokens"] == 2 + 3 + 1 + 1 + 2
    assert out[1]["formatted"] == "<turn >\n</turn>\n" and out[1]["attachments"] == []
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert back[1]["n_turns"] == 2 and back[None]["turns_sha256"] == hashlib.sha256(b"assistant\n\n").hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_long_conversation_in_order(spark):
    big = (1 << 60) + 1
    df = spark.range(3000).select(F.lit(big).alias("conv_id"), (2999 - F.col("id")).alias("turn"), F.lit("assistant").alias("role"),
                                  F.array(F.struct(F.lit("text").alias("type"), (2999 - F.col("id")).cast("string").alias("text"),
                                                   F.lit("").alias("ref"), F.lit(0).cast("long").alias("size"))).alias("parts"))
    r = chat.read_back(chat.format_turns(df)).collect()
    whole = "".join(map(str, range(3000)))
    assert len(r) == 1 and r[0]["conv_id"] == big and r[0]["loss_chars"] == len(whole)
    assert r[0]["loss_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_ties_and_null_turns_match_sql(spark, tmp_path):
    rows = [(1, 2, "a b", "<b"), (1, 2, "a", "Zb"), (1, 2, "a", "<b"), (1, None, "user", "\\l"), (1, None, "user", "<"), (1, 2, "a", "\\"),
            (2, 0, None, None), (2, 0, "assistant", "x" * 300_000), (None, 1, "user", "q"), (None, 1, "assistant", ">")]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], "conv_id long, turn long, role string, text string, formatted string, before int")
    df.repartition(1).write.parquet(str(tmp_path / "conversations.parquet"))
    res = compare(queries.op8_chat_format(spark, str(tmp_path)), str(tmp_path), queries.OP8_SQL)
    assert res["match"], res
