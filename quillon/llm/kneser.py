"""Quality classifier: interpolated modified Kneser-Ney model of bytes, trained on trusted texts.

Units are the bytes of the UTF-8 text, so no text has a unit outside the vocabulary. The n-grams of every trusted text are
counted, all of them; joins of count tables by suffix and by context then give continuation counts, discounts, and from
the lowest order up the interpolated probability of each n-gram and the back-off weight of each context. A text has two
scores: its perplexity, and the perplexity of its worst window, as a few insults vanish in the mean of a long text. It is kept
if both are within a quantile of the trusted texts of its language. That of the window is the one of QUANTILES which parts
trusted from other labelled texts best. A model knows the texts it has counted too well, so for the quantiles each half of the trusted
texts (equal texts in one half) is scored by a model of the other half.

The model is dealt into shards by the byte before the last, which all parts that one position needs have in common, so that
each shard has a bounded size; a pass over the texts with a shard scores the positions that fall into it. One shard does
as long as the model has at most SHARD_ROWS rows.

Defined results: a null or empty text has no perplexity and is not kept; a null language is a language of its own; one
without trusted texts is judged by the quantiles of all; without any trusted text there is no model, no perplexity, and
nothing is kept; labels that disagree make a text untrusted; repeated rows and equal texts agree; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._common import settle, text_of

ORDER = 6
#: Rows of the model in a shard; 16 bytes each.
SHARD_ROWS = 4_000_000
#: Trusted ids that may be broadcast (8 bytes each); with more, texts are shuffled to them.
BROADCAST_IDS = 2_000_000
HIGH = 0.997
#: Quantiles of the worst window to choose from.
QUANTILES = (0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995, 0.997)
#: A window is WIDE cells of CELL bytes.
CELL, WIDE = 8, 2
CHUNK = 2 << 20
_MISS = np.float32(1.0)


def _grams(raw: bytes, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, the last byte lowest; before the text stand line feeds."""
    b = np.frombuffer(b"\n" * (order - 1) + raw, np.uint8).astype(np.int64)
    out = np.zeros(len(raw), np.int64)
    for j in range(order):
        out = out << 8 | b[j : j + len(raw)]
    return out


def _counted(order: int):
    def run(batches):
        keys, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            k, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            return k, np.bincount(inverse, weights=np.concatenate([counts, c])).astype(np.int64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "n"])

        for batch in batches:
            for raw in batch.column("text").cast(pa.binary()):
                held.append(_grams(raw.as_py(), order))
                size += len(held[-1])
                if size >= CHUNK:
                    keys, counts = merged()
                    held, size = [], 0
                    if len(keys) > 2_000_000:
                        yield row()
                        keys, counts = keys[:0], counts[:0]
        if size:
            keys, counts = merged()
        if len(keys):
            yield row()

    return run


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n over all texts (text, not null)."""
    return texts.select("text").mapInArrow(_counted(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _context(g: Column) -> Column:
    return F.shiftright(g, 8)


def model(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """k, key, p, back: for each order k, the n-grams with their probability, and the contexts with their back-off weight.

    An n-gram of order k is a row (k, gram, p, null); a context for order k is a row (k, context, null, back). Order 1 has
    the empty context 0.
    """
    tables = {order: settle(grams, "grams")}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        tables[k] = settle(tables[k + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n")), "grams")
    out, lower = [], None
    for k in range(1, order + 1):
        t = tables[k]
        n = {f"n{i}": F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)}
        c = t.agg(*(v.alias(x) for x, v in n.items())).first()
        y = c.n1 / (c.n1 + 2 * c.n2) if c.n1 else 0.0
        d = [max(0.0, min(i, i - (i + 1) * y * c[f"n{i + 1}"] / c[f"n{i}"])) if c[f"n{i}"] else 0.5 * y for i in (1, 2, 3)]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        by = t.groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("left"))
        back = by.select("context", "total", (F.col("left") / F.col("total")).alias("back"))
        own = t.select("gram", _context(F.col("gram")).alias("context"), ((F.col("n") - off)).alias("rest")).join(back, "context")
        if k == 1:
            p = own.select("gram", (F.col("rest") / F.col("total") + F.col("back") / 256).alias("p"))
        else:
            low = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("low"))
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(low, "suffix")
            p = own.select("gram", (F.col("rest") / F.col("total") + F.col("back") * F.col("low")).alias("p"))
        lower = settle(p, "probabilities")
        out.append(lower.select(F.lit(k).alias("k"), F.col("gram").alias("key"), "p", F.lit(None).cast("double").alias("back")))
        out.append(back.select(F.lit(k).alias("k"), F.col("context").alias("key"), F.lit(None).cast("double").alias("p"), "back"))
    joined = out[0]
    for x in out[1:]:
        joined = joined.unionAll(x)
    return settle(joined, "kneser")


class Table:
    """long keys to floats by hashing with open addresses, looked up by the array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _MISS, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # of the keys that want a free slot one gets it; the others move on
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, _MISS where there is none (values are logarithms, so never above 0)."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.values[slot], _MISS)
        todo = np.nonzero((got != keys) & (got != -1))[0]
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (got != -1)
            todo, slot = todo[on], slot[on]
        return out


class Shard:
    """The part of a model for positions after certain bytes."""

    def __init__(self, rows: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], order: int, after: np.ndarray):
        self.rows, self.order, self.after, self.tables = rows, order, after, None

    def log2(self, raw: bytes) -> np.ndarray:
        """log2 of the probability at each byte, 0 where the position is another shard's."""
        if self.tables is None:
            self.tables = {x: Table(*v) for x, v in self.rows.items()}
        g = _grams(raw, self.order)
        out, left = np.zeros(len(g), np.float32), np.arange(len(g))
        if not self.after.all():
            left = left[self.after[g >> 8 & 255]]
        for k in range(self.order, 0, -1):
            if not len(left):
                break
            some = g[left] & ((1 << (8 * k)) - 1)
            p = self.tables[k, "p"].get(some)
            hit = p < _MISS
            out[left[hit]] += p[hit]
            left, some = left[~hit], some[~hit]
            back = self.tables[k, "back"].get(some >> 8)
            out[left] += np.where(back < _MISS, back, 0)  # an unseen context leaves all to the lower order
            if k == 1:
                out[left] -= 8
        return out

    def cells(self, raw: bytes) -> np.ndarray:
        """Sums of log2 over each CELL bytes."""
        return np.add.reduceat(self.log2(raw), np.arange(0, len(raw), CELL), dtype=np.float64) if raw else np.zeros(0)


def summed(cells: np.ndarray, n: int) -> tuple[float | None, float | None]:
    """Bits of a text of n bytes for each byte, and those of its worst window."""
    if not n:
        return None, None
    c = np.concatenate([[0.0], np.cumsum(cells)])
    at = np.minimum(np.arange(len(c)) * CELL, n)
    k = min(WIDE, len(cells))
    return -c[-1] / n, float(np.max((c[:-k] - c[k:]) / (at[k:] - at[:-k])))


def _after() -> Column:
    last = F.when(F.col("p").isNotNull(), _context(F.col("key"))).otherwise(F.col("key")).bitwiseAND(F.lit(255))
    return F.when(F.col("k") == 1, -1).otherwise(last)


def parts(rows: DataFrame, most: int = SHARD_ROWS):
    """Lists of bytes: the shards of a model. The rows after the bytes of one are about most at most, unless one byte has more."""
    sizes = {r.after: r["count"] for r in rows.groupBy(_after().alias("after")).count().collect()}  # 257 rows at most
    held, size = [], 0
    for b in range(256):
        if held and size + sizes.get(b, 0) > most:
            yield held
            held, size = [], 0
        held.append(b)
        size += sizes.get(b, 0)
    yield held


def shard(rows: DataFrame, after: list[int], order: int, whole: bool) -> Shard:
    """The model's part for positions after these bytes."""
    own = rows if whole else rows.where(_after().isin(-1, *after))
    t = own.select("k", "key", F.coalesce("p", "back").alias("v"), F.col("p").isNotNull().alias("gram")).toArrow()
    k, key, v, gram = (t.column(n).to_numpy() for n in ("k", "key", "v", "gram"))
    v = np.log2(np.maximum(v, 1e-30)).astype(np.float32)
    made = {(o, n): (key[(k == o) & (gram == x)].copy(), np.minimum(v[(k == o) & (gram == x)], 0)) for o in range(1, order + 1) for n, x in (("p", True), ("back", False))}
    on = np.zeros(256, bool)
    on[after] = True
    return Shard(made, order, on)


def _scored(shared, names):
    def run(batches):
        shard = shared.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            both = [summed(shard.cells(x), len(x)) for x in texts]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([b for b, _ in both], pa.float64()), pa.array([w for _, w in both], pa.float64())], names=[*names, "bits", "top"])

    return run


def _cells(shared):
    def run(batches):
        shard = shared.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            cells = pa.array([shard.cells(x).astype(np.float32).tobytes() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), cells, pa.array([len(x) for x in texts], pa.int64())], names=["digest", "cells", "n"])

    return run


def _totals(batches):
    for batch in batches:
        both = [summed(np.sum([np.frombuffer(x, np.float32) for x in parts], axis=0, dtype=np.float64), n) for parts, n in zip(batch.column("parts").to_pylist(), batch.column("n").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([b for b, _ in both], pa.float64()), pa.array([w for _, w in both], pa.float64())], names=["digest", "bits", "top"])


def perplexities(docs: DataFrame, keys: list[str], rows: DataFrame, order: int = ORDER, most: int = SHARD_ROWS) -> DataFrame:
    """keys, perplexity and worst (that of the worst window) of every row of docs (null for an empty text). rows: a model.

    A shard is broadcast, used and let go before the next one is read, so the driver and an executor hold one at a time.
    """
    sc = docs.sparkSession.sparkContext
    scores = [F.pow(F.lit(2.0), n).alias(x) for n, x in (("bits", "perplexity"), ("top", "worst"))]
    whole = docs.select(*keys, text_of().alias("text"))
    dealt = list(parts(rows, most))
    if len(dealt) == 1:
        schema = T.StructType([whole.schema[n] for n in keys]).add("bits", "double").add("top", "double")
        return whole.mapInArrow(_scored(sc.broadcast(shard(rows, dealt[0], order, True)), keys), schema).select(*keys, *scores)
    texts = settle(whole.select("text").groupBy(F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text")), "texts")
    cells = None
    for own in dealt:
        shared = sc.broadcast(shard(rows, own, order, False))
        done = settle(texts.mapInArrow(_cells(shared), "digest binary, cells binary, n long"), "cells")
        shared.destroy()
        cells = done if cells is None else cells.unionAll(done)
    total = cells.groupBy("digest").agg(F.collect_list("cells").alias("parts"), F.first("n").alias("n")).mapInArrow(_totals, "digest binary, bits double, top double")
    mine = docs.select(*keys, F.unhex(F.sha2(text_of(), 256)).alias("__digest"))
    return mine.join(total, mine["__digest"] == total["digest"]).select(*(mine[k] for k in keys), *scores)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the texts whose labels all say good and not toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0 and doc_id is not null").select("doc_id")


def parting(good: DataFrame, others: DataFrame, high: float = HIGH, quantiles=QUANTILES) -> tuple[DataFrame, tuple]:
    """__lang, __mean, __window (the largest scores that its trusted texts leave to be kept) and the same two for all languages.

    Of quantiles of the window that is taken whose share of trusted texts kept exceeds that of other labelled texts most; of equal ones
    the largest.
    """
    good = good.where("perplexity is not null")
    at = [F.percentile_approx(c, F.lit(q), F.lit(10_000)).alias(n) for c, q, n in (("perplexity", high, "mean"), ("worst", list(quantiles), "window"))]
    by = settle(good.groupBy(F.col("lang").alias("__lang")).agg(*at), "bounds")
    every = good.agg(*at).first()
    if every["mean"] is None:
        every = {"mean": None, "window": [None] * len(quantiles)}
    mean = F.coalesce("mean", F.lit(every["mean"]).cast("double"))
    window = lambda i: F.coalesce(F.get("window", F.lit(i)), F.lit(every["window"][i]).cast("double"))
    marked = good.withColumn("__good", F.lit(True)).unionByName(others.withColumn("__good", F.lit(False)))
    marked = marked.join(F.broadcast(by), marked["lang"].eqNullSafe(by["__lang"]), "left")
    kept = [F.coalesce((F.col("perplexity") <= mean) & (F.col("worst") <= window(i)), F.lit(False)).cast("double") for i in range(len(quantiles))]
    shares = {r["__good"]: r for r in marked.groupBy("__good").agg(*(F.avg(k).alias(f"k{i}") for i, k in enumerate(kept))).collect()}
    share = lambda x, i: shares[x][f"k{i}"] if x in shares else 0.0
    i = max(range(len(quantiles)), key=lambda i: (share(True, i) - share(False, i), quantiles[i]))
    return by.select("__lang", F.col("mean").alias("__mean"), F.get("window", F.lit(i)).alias("__window")), (every["mean"], every["window"][i])


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, high: float = HIGH, quantiles=QUANTILES) -> DataFrame:
    """doc_id, perplexity, worst, most, worst_most (the bounds for its language) and kept of every row of docs (doc_id, text, lang)."""
    trusted = settle(trusted_ids(labels), "trusted")
    others = labels.where("doc_id is not null").select("doc_id").distinct().join(trusted, "doc_id", "left_anti")
    ids = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    known = docs.where("text is not null and text != ''").select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    halves = [known.where(F.xxhash64("text").bitwiseAND(F.lit(1)) == i) for i in (0, 1)]
    grams = [settle(counts(h, order), "grams") for h in halves]
    fitted = model(grams[0].unionAll(grams[1]).groupBy("gram").agg(F.sum("n").alias("n")), order)
    null = F.lit(None).cast("double")
    keys = ["doc_id", "lang"]
    scored = settle(perplexities(docs, keys, fitted, order), "perplexity") if not fitted.isEmpty() else docs.select(*keys, null.alias("perplexity"), null.alias("worst"))
    if any(g.isEmpty() for g in grams):
        good = scored.join(trusted, "doc_id", "left_semi")
    else:
        held = [perplexities(h, keys, model(g, order), order) for h, g in zip(halves, reversed(grams))]
        good = settle(held[0].unionAll(held[1]), "held")
    by, every = parting(good, scored.join(others, "doc_id", "left_semi"), high, quantiles)
    out = scored.join(by, scored["lang"].eqNullSafe(by["__lang"]), "left")
    most, window = (F.coalesce(c, F.lit(v).cast("double")) for c, v in zip(("__mean", "__window"), every))
    out = out.select("doc_id", "perplexity", "worst", most.alias("most"), window.alias("worst_most"))
    kept = (F.col("perplexity") <= F.col("most")) & (F.col("worst") <= F.col("worst_most"))
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, perplexity, worst, their bounds and kept of every document; null and empty texts are not kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
