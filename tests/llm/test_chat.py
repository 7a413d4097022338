import random

from pyspark.sql import functions as F

from lectern.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, spans string"


def read(spark, rows):
    done = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return {r["conv_id"]: r for r in done.select("conv_id", "formatted", "spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("spans")).alias("loss")).collect()}


def test_every_turn_reads_back(spark):
    rng = random.Random(1)
    parts = ["<turn>", "<text>", "</turn>", "\n", "\\", "\\b", "\\l", "<", "l", "b", "é🚀", " ", "turn>", "### Assistant:"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a\\<text>"]), "".join(rng.choices(parts, k=rng.randrange(9))), "x") for c in range(60) for t in range(rng.randrange(1, 9))]
    got = read(spark, rows)
    assert len(got) == 60
    for c, r in got.items():
        turns = [(x[2], x[3]) for x in rows if x[0] == c]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert len(r["spans"]) == sum(role == "assistant" for role, _ in turns)
        assert r["formatted"].count("<turn>") == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))


def test_nulls_ties_and_empty(spark):
    got = read(spark, [(None, None, None, None, None), (1, 2, "user", "b", None), (1, 2, "user", "a", None), (1, None, "assistant", None, None), (1, 2, "user", "a", None)])
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")] and got[None]["loss"] == ""
    assert [tuple(t) for t in got[1]["turns"]] == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert read(spark, []) == {}


def test_long_text(spark):
    text = "<turn>\\ é" * 50_000
    got = read(spark, [(1, 0, "assistant", text, None)])
    assert got[1]["loss"] == text and got[1]["turns"][0]["text"] == text


def test_ties_sort_by_what_was_said_not_by_its_escapes(spark):
    texts = ["=x", "<turn>", "\\", "a\\b", "<", "]"]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in texts] + [(2, 0, "<text>", "a"), (2, 0, "=", "b"), (2, 0, "<text>", "a")], "conv_id int, turn int, role string, text string").repartition(3)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.format_chats(turns).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got[1] == [("user", t) for t in sorted(texts)]
    assert got[2] == [("<text>", "a"), ("<text>", "a"), ("=", "b")]
