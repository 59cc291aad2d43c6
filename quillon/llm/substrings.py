"""Exact substring dedup by difference-cover anchors.

A cover of residues modulo a period holds, for every difference, two residues that differ by it. So if 35 words stand in
two places, among the first 21 offsets of that match there is one at which both places lie on cover residues, and the 15
words that start there are an anchor of both. Hashing only the anchors (5 of 21 positions) therefore misses no match.

1. Distinct texts are written once, bucketed by a hash, so that no later step shuffles them.
2. Anchors that occur twice mark where a match can be. Each batch of texts sends a hash once, however often it has it.
3. Around such anchors the windows of the full length are hashed (128 bits) and matched in the same way: the extension.
4. The words under matched windows go.

No pair of places is ever formed, and a run of equal hashes passes through a task one batch at a time; a passage in a third
of the texts costs a row for each batch of texts. Texts with an exact copy need no match of their own.

Defined results: a null text has no words; rows with equal texts are copies of each other, whatever their doc_id, so each
of them loses all its words if it has a window at all; an empty table gives an empty result; other columns are left out.
Anchors are matched by 64 bits, which can only add candidates; windows by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import new_path, owned_table, passing, release, settle, text_of

#: Words of a window; the period, a perfect difference cover of it, and the words of an anchor.
LENGTH, PERIOD = 35, 21
COVER = (0, 1, 4, 14, 16)
#: Bytes of texts that are hashed at a time.
CHUNK = 4 << 20
ORD = 40  # an address is the number of the text among those with its hash, and below ORD bits the word's number

_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_M = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """128 bits of each word of all texts, one after the other: an array of two columns."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    flat = b"".join([digest(w) for t in texts for w in t])
    return np.frombuffer(flat, np.uint64).reshape(-1, 2)


def _join(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    x = a * _K[which] + b
    x ^= x >> np.uint64(31)
    x *= _M[which]
    x ^= x >> np.uint64(29)
    return x


def window_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of every n consecutive words, from those of one word, by doubling; the last step overlaps."""
    size = 1
    while size * 2 <= n:
        h = _join(h[: len(h) - size], h[size:], which)
        size *= 2
    if size < n:
        h = _join(h[: len(h) - (n - size)], h[n - size :], which)
    return h


def _chunks(batch, *others):
    """Of a batch: lists of words with what others have in the same rows, CHUNK bytes at a time."""
    texts = batch.column("text").cast(pa.binary())
    rest = [batch.column(n) for n in others]
    at, held, size = 0, [], 0
    for i in range(len(texts)):
        raw = texts[i].as_py()
        held.append(raw.split())
        size += len(raw)
        if size >= CHUNK or i == len(texts) - 1:
            yield held, [c.slice(at, i + 1 - at) for c in rest]
            at, held, size = i + 1, [], 0


_ROWS = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("sure", pa.int8())])


def _sent(p: np.ndarray, q: np.ndarray, k: np.ndarray, at: np.ndarray):
    """Rows for repeated(): sure is 0 for a hash that stands once here, 2 for the first of several and 1 for the others.

    Rows of the last kind are known to be repeated; they travel under their text's key.
    """
    order = np.lexsort((q, p))
    ps, qs = p[order], q[order]
    same = (ps[1:] == ps[:-1]) & (qs[1:] == qs[:-1])
    prev, nxt = np.concatenate([[False], same]), np.concatenate([same, [False]])
    sure = np.empty(len(p), np.int8)
    sure[order] = np.where(prev, 1, np.where(nxt, 2, 0))
    # rows keep the order of the texts, and what is known needs no hash: both pack well in the shuffle
    known = sure == 1
    p, q = np.where(known, k, p.view(np.int64)), np.where(known, 0, q.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(k), pa.array(at), pa.array(sure)], schema=_ROWS)


def _laid_out(texts, keys, ords):
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    pos = np.arange(len(row)) - starts[row]
    return sizes, row, pos, keys.to_numpy(), ords.to_numpy().astype(np.int64)


def _anchors(length, period, cover):
    def run(batches):
        n = length - period + 1
        on = np.isin(np.arange(period), cover)
        for batch in batches:
            for texts, (keys, ords) in _chunks(batch, "k", "ord"):
                sizes, row, pos, k, o = _laid_out(texts, keys, ords)
                if len(row) < n:
                    continue
                h = window_hashes(word_hashes(texts)[:, 0].copy(), n)
                i = np.arange(len(h))
                # a text too short for a window has no match
                i = i[on[pos[i] % period] & (pos[i] + n <= sizes[row[i]]) & (sizes[row[i]] >= length)]
                if len(i):
                    yield _sent(h[i], np.zeros(len(i), np.uint64), k[row[i]], o[row[i]] << ORD | pos[i])

    return run


def _windows(length, period):
    def run(batches):
        reach = period - 1
        for batch in batches:
            for texts, (keys, ords, spots) in _chunks(batch, "k", "ord", "spots"):
                sizes, row, pos, k, o = _laid_out(texts, keys, ords)
                starts = np.cumsum(sizes) - sizes
                edge = np.zeros(len(row) + 1, np.int64)
                for t, s in enumerate(spots):
                    s = s.values.to_numpy()
                    s = np.sort(s[s >> ORD == o[t]] & ((1 << ORD) - 1))
                    lo, hi = np.maximum(s - reach, 0), np.minimum(s, sizes[t] - length) + 1
                    ok = lo < hi
                    np.add.at(edge, starts[t] + lo[ok], 1)
                    np.add.at(edge, starts[t] + hi[ok], -1)
                i = np.nonzero(np.cumsum(edge)[:-1])[0]
                if len(i):
                    h = word_hashes(texts)
                    p, q = (window_hashes(h[:, w].copy(), length, w)[i] for w in (0, 1))
                    yield _sent(p, q, k[row[i]], o[row[i]] << ORD | pos[i])

    return run


def _repeated(batches):
    """k, at of the rows whose hash others have too. The batches come in the order of p and q."""
    held = None  # the last row, which the next may equal: (p, q, k, at, sure, given out)
    for batch in batches:
        p, q, k, at, sure = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("p", "q", "k", "at", "sure"))
        known = sure == 1
        out_k, out_at = [k[known]], [at[known]]
        p, q, k, at, sure = (x[~known] for x in (p, q, k, at, sure))
        given = np.zeros(len(p), bool)
        if held is not None:
            p, q, k, at, sure, given = (np.concatenate([[x], y]) for x, y in zip(held, (p, q, k, at, sure, given)))
        if len(p):
            same = (p[1:] == p[:-1]) & (q[1:] == q[:-1])
            dup = (sure == 2) | np.concatenate([[False], same]) | np.concatenate([same, [False]])
            new = dup & ~given.astype(bool)
            out_k.append(k[new])
            out_at.append(at[new])
            held = (p[-1], q[-1], k[-1], at[-1], sure[-1], bool(dup[-1] or given[-1]))
        if sum(map(len, out_k)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_k, out_at)], names=["k", "at"])


def _kept(length):
    def run(batches):
        for batch in batches:
            keys, ords, spots, texts = (batch.column(n) for n in ("k", "ord", "spots", "text"))
            out = []
            for t in range(len(keys)):
                raw = texts[t].as_py()
                w = raw.encode().split()
                n = len(w)
                gone = 0
                s = np.array(spots[t].as_py() or (), np.int64)
                s = s[s >> ORD == ords[t].as_py()] & ((1 << ORD) - 1)
                if len(s):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + length, -1)
                    stay = np.cumsum(edge)[:n] == 0
                    gone = n - int(stay.sum())
                    w = [x for x, keep in zip(w, stay.tolist()) if keep]
                joined = b" ".join(w)
                out.append((keys[t].as_py(), hashlib.sha256(raw.encode()).digest(), n, gone, hashlib.sha256(joined).hexdigest(), joined.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["k", "digest", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """k, ord, text: the distinct texts, in a table bucketed by their hash k; ord numbers those with the same hash."""
    spark = docs.sparkSession
    path = new_path(spark, "texts")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    t = docs.select(text_of().alias("text")).groupBy(F.xxhash64("text").alias("k")).agg(F.sort_array(F.collect_set("text")).alias("texts"))
    t = t.select("k", F.posexplode("texts").alias("ord", "text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t.write.bucketBy(buckets, "k").sortBy("k").option("path", path).option("compression", "zstd").saveAsTable(name)
    owned_table(spark, name)
    passing(spark, path)
    return spark.table(name)


def _spots(sent: DataFrame, name: str) -> DataFrame:
    """k and its repeated addresses: spots."""
    ranked = sent.repartition("p").sortWithinPartitions("p", "q")
    found = ranked.mapInArrow(_repeated, "k long, at long")
    return settle(found.groupBy("k").agg(F.collect_list("at").alias("spots")), name)


def dedup(docs: DataFrame, keys: list[str], length: int = LENGTH, period: int = PERIOD, cover: tuple = COVER, texts: bool = True) -> DataFrame:
    """keys, n_words, n_removed, kept_sha256 and, if texts, kept (the words that stay, joined by one space) of every row."""
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and period <= length, "not a difference cover"
    spark, sent = docs.sparkSession, "p long, q long, k long, at long, sure byte"
    t = _texts(docs)
    release(spark)
    spots = _spots(t.mapInArrow(_anchors(length, period, cover), sent), "anchors")
    release(spark)
    near = t.join(spots, "k").select("k", "ord", "text", "spots")
    spots = _spots(near.mapInArrow(_windows(length, period), sent), "windows")
    release(spark)
    all_texts = t.join(spots, "k", "left").select("k", "ord", "text", "spots")
    done = all_texts.mapInArrow(_kept(length), "k long, digest binary, n_words long, n_removed long, kept_sha256 string, kept string")
    done = done if texts else done.drop("kept")
    rows = docs.select(*keys, F.xxhash64(text_of()).alias("__k"), F.unhex(F.sha2(text_of(), 256)).alias("__digest"))
    copies = rows.groupBy("__k", "__digest").count().where("count > 1").select(F.col("__k").alias("__ck"), F.col("__digest").alias("__cd"))
    done = done.join(copies, (done["k"] == copies["__ck"]) & (done["digest"] == copies["__cd"]), "left")
    whole = F.col("__ck").isNotNull() & (F.col("n_words") >= length)
    picked = [F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    if texts:
        picked.append(F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    # written, so that both sides of the join are shuffled as they are and the many copies of a text can be split
    done = settle(done.select("k", "digest", "n_words", *picked), "kept")
    out = rows.join(done, (rows["__k"] == done["k"]) & (rows["__digest"] == done["digest"]))
    return out.select(*(rows[c] for c in keys), "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else []))


#: The same for DuckDB, by comparing the windows themselves (their MD5).
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH})),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + {LENGTH})) AS j FROM m),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT p.r, count(*) AS n, string_agg(word, ' ' ORDER BY p.j) AS t FROM p ANTI JOIN c ON p.r = c.r AND p.j = c.j GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; a null text has no words."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"], texts=False)
