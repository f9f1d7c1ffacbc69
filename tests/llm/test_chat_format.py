import random

from pixelloom.llm import chat_format as c
from pyspark.sql import functions as F

PART = f"conv_id long, turn long, role string, parts array<{c.PART}>"


def part(type_, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (type_, text, ref, width, height, seconds, pages)


def test_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "look: "), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=2.5), part(None, "x")]),
        (1, 1, "assistant", [part("text", "<attach:image:0> is </turn>"), part("document", ref="c.pdf", pages=2)]),
        (1, 2, "assistant", []),
        (1, 3, None, None),
    ]
    r = c.read_back(c.format_chat(spark.createDataFrame(rows, PART))).first()
    assert [(a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 2048)]
    assert r.n_tokens_attached == 4 + 63 + 2048
    assert r.formatted.startswith("<turn:user>\nlook: \n<attach:image:0>\n<attach:audio:1>\nx</turn>\n<turn:assistant>\n<\\attach:image:0> is <\\/turn>\n<attach:document:2></turn>\n")
    assert [t.role for t in r.turns] == ["user", "assistant", "assistant", ""]
    assert r.loss_texts == ["<attach:image:0> is </turn>\n<attach:document:2>", ""]
    for s in r.loss_spans:
        assert r.formatted[r.turn_starts[s.turn] : s.end].startswith("<turn:assistant>\n")


def test_exact_round_trip(spark):
    rng = random.Random(2)
    pieces = ["<", "\\", "/", "turn", "</turn>", "<turn:", "<\\/turn>\n", ">", "\n", "attach:", "é", "𝒳", " ", "<\\\\turn", "\\n"]
    draw = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(0, n)))
    rows = [(k // 5, k % 5, rng.choice(["user", "assistant", draw(3)]), draw(12)) for k in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", c.text_part(F.col("text")))
    for r in c.read_back(c.format_chat(turns)).collect():
        own = rows[r.conv_id * 5 : r.conv_id * 5 + 5]
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in own]
        assert r.loss_texts == [text for _, _, role, text in own if role == "assistant"]
        assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [r.formatted[r.turn_starts[s.turn] + len("<turn:assistant>\n") : s.end] for s in r.loss_spans]
        assert r.formatted.count("</turn>\n") == 5


def test_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", None), (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, None, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, schema).withColumn("parts", c.text_part(F.col("text"))).withColumn("formatted", F.lit("mine"))
    got = {r.conv_id: r for r in c.read_back(c.format_chat(df)).collect()}
    assert [t.text for t in got[None].turns] == [""]
    assert [t.text[:1] for t in got[1].turns] == ["x", "a", "b", "b"] and len(got[1].loss_texts[0]) == 100_000
    assert c.format_chat(df.limit(0)).count() == 0
