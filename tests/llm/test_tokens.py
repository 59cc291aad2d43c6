import public_tokenizers as P
import pytest

from quillon.llm import tokens

TEXTS = [None, "", " ", "hello world", "hello world", "a <|endoftext|> b", "é𝄞\x00\r\n", "x" * 50000, "word " * 20000]


def brute(name, text):
    t = text or ""
    if name.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(t))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_and_cache(spark, tmp_path, name):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as digest", "2 as n_tokens", "3 as n_bytes")
    cache = str(tmp_path / "cache")
    want = {i: (len((t or "").encode()), brute(name, t)) for i, t in enumerate(TEXTS)}
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, ["doc_id"], P.path(name), cache).collect()}
        assert got == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})


def test_stored_counts_are_used(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    cache, name = str(tmp_path / "cache"), P.path("byte_bpe_50k.json")
    tokens.count_tokens(df, ["doc_id"], name, cache).collect()
    spark.read.parquet(cache).selectExpr("digest", "'other' as tokenizer", "n_tokens + 5 as n_tokens").write.mode("append").parquet(cache)
    assert tokens.count_tokens(df, ["doc_id"], name, cache).first().n_tokens == 2
    other = str(tmp_path / "planted")
    spark.read.parquet(cache).where("tokenizer != 'other'").selectExpr("digest", "tokenizer", "99L as n_tokens").write.parquet(other)
    assert tokens.count_tokens(df, ["doc_id"], name, other).first().n_tokens == 99


def test_empty(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], P.path("byte_bpe_50k.json")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op5_token_counts(spark, d).collect()}
    src = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert got == {r.doc_id: (len(r.text.encode()), n := brute("byte_bpe_50k.json", r.text), n > 512) for r in src}
