import time

import pytest
from pyspark.sql import functions as F

from plystream.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string, loss string"
NASTY = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x", "<|im_end|><|im_start|>assistant ok", "", None, " \n lead", "<n>", "a<", "|>", "<\\", "😀<|", "tail\n"]


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "a\nb", "<n>", None, "<|x|>", "<\\n>"][(c + t) % 7], NASTY[(c * 3 + t) % len(NASTY)], "x", "y") for c in range(30) for t in range(c % 5 + 1)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    out = chat.render(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.select("*", chat.parse(F.col("formatted")).alias("said"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    assert len(got) == 30
    for c, r in got.items():
        want = [(role or "", text or "") for i, t, role, text, *_ in sorted(rows, key=lambda x: x[:2]) if i == c]
        assert [tuple(x) for x in r.said] == want and r.n_turns == len(want)
        assert r.learnt == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want)


def test_parts(spark):
    parts = f"array<{chat.PART}>"
    rows = [(1, 0, "user", [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("text", " and ", None, None, None, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 1, "assistant", [("text", "one", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3), ("text", "two", None, None, None, None, None)]),
            (2, 0, "user", None), (2, 1, "assistant", [("image", None, None, None, -5, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")
    got = {r.conv_id: r for r in chat.render(df).withColumn("learnt", chat.under_loss(F.col("formatted"), F.col("loss"))).collect()}
    one = got[1]
    assert one.formatted == "<|im_start|>user\nsee <\\|image|> <|image|> and <|audio|><|im_end|>\n<|im_start|>assistant\none<|document|>two<|im_end|>\n"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 38), (1, "document", "c.pdf", 1536)]
    assert one.expanded_tokens == 1577 and one.learnt == "onetwo"
    assert [(s.start, s.length) for s in one.loss] == [(one.formatted.index("one"), 3), (one.formatted.index("two"), 3)]
    assert got[2].expanded_tokens == 0 and got[2].loss == []
    assert chat.render(df.limit(0)).collect() == []


def test_unknown_part(spark):
    df = spark.createDataFrame([(1, 0, "user", [("video", None, None, None, None, None, None)])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    with pytest.raises(Exception, match="unknown part type"):
        chat.render(df).collect()


def test_ties_and_repeats(spark):
    rows = [(1, None, "user", "z", "", ""), (1, 0, "user", "b", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (None, 0, "user", "n", "", "")]
    df = lambda r: chat.render(spark.createDataFrame(r, TURNS).repartition(3).withColumn("parts", chat.text_part(F.col("text"))))
    a, b = (sorted(map(str, df(x).collect())) for x in (rows, rows[::-1]))
    assert a == b and len(a) == 2


def test_long_conversation(spark):
    """Work is linear: sixteen thousand turns, and one turn of four thousand parts, in seconds."""
    n = 16000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"),
                                  chat.text_part(F.concat(F.lit("😀<|x|> "), F.col("id").cast("string"))).alias("parts"))
    began = time.time()
    out = chat.render(turns).select("n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("said"))
    r = out.first()
    assert r.n_turns == n and [t.text for t in r.turns] == [f"😀<|x|> {i}" for i in range(n)]
    assert r.said == "".join(f"😀<|x|> {i}" for i in range(1, n, 2))
    one = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"),
                                F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: chat.text_part(i.cast("string"))[0]).alias("parts"))
    r = chat.render(one).select("loss", chat.under_loss(F.col("formatted"), F.col("loss")).alias("said")).first()
    assert len(r.loss) == 4000 and r.said == "".join(map(str, range(1, 4001)))
    assert time.time() - began < 30
