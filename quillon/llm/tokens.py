"""Token counts with a digest cache.

A text's digest is the SHA-256 of its normalised content; a cache holds counts by content digest and tokenizer digest
(the SHA-256 of the tokenizer's file, so another version never meets old counts). Texts are made distinct by digest before
they are shuffled to one place each, joined to the cache by digest only, and encoded if the cache has no count. New counts
are appended to the cache; the counts then come back to the rows by digest.

The normaliser must not change a count. The default leaves texts as they are, which is right for every tokenizer.

Defined results: a null text is empty; an empty text has 0 tokens; ties and repeated rows are encoded once; an empty table
gives an empty result; other columns are left out. Special strings inside texts are handled as the library does by default.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import new_path, settle, text_of

LIMIT = 512
CACHE = "digest binary, tokenizer string, n_tokens long"
#: Bytes of text that go to the tokenizer at a time.
CHUNK = 1 << 20


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def encoder(path: str):
    """texts to token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _counted(path: str):
    def run(batches):
        count = encoder(path)
        for batch in batches:
            digests, texts, n = batch.column("digest"), batch.column("text"), []
            sizes = texts.cast(pa.binary()).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(sizes[end]) <= CHUNK):
                    size, end = size + len(sizes[end]), end + 1
                n += count(texts.slice(at, end - at).to_pylist())
                at = end
            yield pa.RecordBatch.from_arrays([digests, pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def _cache(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, keys: list[str], tokenizer: str, cache: str | None = None, normalise=lambda t: t) -> DataFrame:
    """keys, n_bytes and n_tokens of every row of docs. tokenizer: a .json or .model file that every executor has.

    cache: the folder of the stored counts, to which new ones are appended; a new one in the shared folder if None.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    version = tokenizer_digest(tokenizer)
    text = normalise(text_of())
    digest = F.unhex(F.sha2(text, 256))
    known = _cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    texts = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = texts.join(known.select("digest"), "digest", "left_anti").select("digest", "text")
    made = misses.mapInArrow(_counted(tokenizer), "digest binary, n_tokens long")
    made.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # a job that ran twice at a time may have stored a count twice
    counts = _cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    # written, so that both sides of the join are shuffled as they are and the many copies of a text can be split
    counts = settle(counts, "token-counts")
    rows = docs.select(*keys, digest.alias("__digest"), F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return rows.join(counts, rows["__digest"] == counts["digest"]).select(*(rows[k] for k in keys), "n_bytes", "n_tokens")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; a null text is empty."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = count_tokens(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
