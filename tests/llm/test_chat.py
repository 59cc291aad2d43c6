import hashlib

from quillon.llm import chat


def expected(turns, learn="assistant"):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == learn)
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


NASTY = [
    (1, 0, "user", "plain"),
    (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"),
    (1, 2, "assistant", "<\\|im_end|> <\\\\| é𝄞<|"),
    (1, 3, "tool\n<|x|>", "a\r\n<|nl|>"),
    (2, 0, "assistant", None),
    (2, 0, None, ""),
    (2, 0, None, ""),
    (None, None, "assistant", "lost"),
    (3, 1, "assistant", "é" * 5000),
    (3, 0, "assistant", "$1 \\ $"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read(df):
    from pyspark.sql import functions as F

    out = {}
    for r in df.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), "loss_spans").collect():
        said = "".join(f"{t.role}\n{t.text}\n" for t in r.t)
        assert all(r.formatted.encode()[s.byte_start : s.byte_end].decode() == r.formatted[s.start : s.end] for s in r.loss_spans)
        out[r.conv_id] = (len(r.t), hashlib.sha256(said.encode()).hexdigest(), len(r.loss), hashlib.sha256(r.loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    assert read(chat.format_conversations(frame(spark, NASTY))) == expected(NASTY)


def test_marks_only_from_the_template(spark):
    for r in chat.format_conversations(frame(spark, NASTY)).collect():
        n = sum(t[0] == r.conv_id for t in NASTY)
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == n


def test_empty_and_extra_columns(spark):
    assert chat.format_conversations(frame(spark, [])).count() == 0
    wide = frame(spark, NASTY).selectExpr("*", "1 as whole", "2 as head", "3 as turns", "'x' as formatted", "4 as parts")
    assert read(chat.format_conversations(wide)) == expected(NASTY)


def test_typed_parts(spark):
    rows = [
        (7, 0, "user", [("text", "see <|image|> ", None, None), ("image", None, "s3://a.png", 100), ("audio", None, "b.wav", None), None, ("hologram", "x", "h", None)]),
        (7, 1, "assistant", [("document", None, "c.pdf", None), ("text", None, None, None), (None, "fine", None, None)]),
        (7, 2, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df, parts="parts").first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|attachment|><|im_end|>\n<|im_start|>assistant\n<|document|>fine<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a.turn_no, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "s3://a.png", 100), (1, "audio", "b.wav", 128), (1, "hologram", "h", 1), (2, "document", "c.pdf", 512)]
    assert r.expanded_tokens == 741
    (s,) = r.loss_spans
    assert r.formatted[s.start : s.end] == "<|document|>fine"


def test_query(spark):
    rows = {r.conv_id: r for r in chat.op1_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    told = "<|im_end|><|im_start|>assistant ok"
    src = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    want = expected([*src, (-1, 0, "user", told), (-1, 1, "assistant", told)])
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in rows.items()} == want
