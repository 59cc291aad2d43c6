"""Benchmark decontamination: item-sized windows of texts within an edit distance of an item.

Words are lower-cased (A-Z). A window of an item's size is a leak if its edit distance to the item, in words, is a fifth of
the item's words at most. Windows and items are embedded by random walks (Chakraborty, Goldenberg, Koucky): step j writes
the word under a pointer and moves the pointer on if a random function of j and the word says so; edit distance becomes
Hamming distance. Locality-sensitive hashing samples positions of the embeddings; a window meets an item if the words at
all positions of one of several samples agree. The number of samples is chosen for each class of item sizes: the least whose
recall reaches the target on random edits of the class's own items, at the largest distance; where none does, all windows of
the class go on to the check, so that its recall is whole. What meets is verified by the exact edit distance (bit-parallel),
so every row returned is a leak.

Windows that can't be leaks are not embedded: t edits leave one of an item's t + 1 unedited stretches whole, so a leak
shares a run of (n - t) / (t + 1) words with its item, moved by t at most. This skips no window within the distance.

Items are taken in blocks of bounded size, as a query set that each pass over the texts carries along.

Defined results: null and empty texts have no windows; items of fewer than MIN_WORDS words say too little and match nothing;
equal items each get their rows; repeated rows each get their rows; no texts or no items, no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS, DISTANCE = 5, 0.2
#: Positions in a sample, embeddings, and the numbers of samples from which the recall picks.
PICKED, WALKS, SAMPLES, RECALL = 4, 8, (8, 16, 32, 64, 128), 0.99
#: Least sizes of the classes of items, and random edits of a class on which its recall is measured.
CLASSES, TRIALS = (5, 8, 12, 20, 35, 60, 100, 200, 500), 400
#: Words of windows that are embedded at a time.
WORDS_AT_ONCE = 1 << 20
#: Items and words of items in a block.
BLOCK, BLOCK_WORDS = 20_000, 2_000_000
CHUNK, FLUSH = 4 << 20, 40_000
STRETCH = 3  # steps of a walk by word


def places(a) -> dict:
    """For each word of a, the places that have it, as the bits of a number."""
    out: dict = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def edit_distance(a, b, most: int, at: dict | None = None) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger. at: places(a), if known.

    A column of the usual table is two numbers, whose bits say where it rises and falls by one (Myers, Hyyro), so that a step
    takes a few operations on numbers of len(a) bits.
    """
    m, far = len(a), most + 1
    if abs(m - len(b)) > most:
        return far
    if not m:
        return len(b)
    at = places(a) if at is None else at
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, left = whole, 0, m, len(b)
    for x in b:
        same = at.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (whole & ~(diagonal | up)), up & diagonal
        left -= 1
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        if score - left > most:
            return far
        right_up, right_down = (right_up << 1 | 1) & whole, (right_down << 1) & whole
        up, down = right_down | (whole & ~(same | down | right_up)), right_up & (same | down)
    return min(score, far)


def allowed(n: int) -> int:
    return int(DISTANCE * n)


def run_length(n: int) -> int:
    """Words of the run that a window within allowed(n) of n words must share."""
    t = allowed(n)
    return -(-(n - t) // (t + 1))


def size_class(n: int) -> int:
    return bisect_right(CLASSES, n) - 1


class Items:
    """A block of items, ready for matching. Word numbers start at 1; 0 is any other word."""

    def __init__(self, items: list[tuple], seed: int = 0, recall: float = RECALL, samples: int | None = None):
        words = [(i, (t or "").encode().lower().split()) for i, t in items]
        self.ids = [i for i, w in words if len(w) >= MIN_WORDS]
        raw = [w for _, w in words if len(w) >= MIN_WORDS]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for x in raw for w in x}))}
        self.items = [[self.vocabulary[w] for w in x] for x in raw]
        rng = np.random.default_rng(seed)
        self.symbols = rng.integers(1, 2**63, len(self.vocabulary) + 2, np.uint64)
        self.symbols[-1] = 0  # past the end
        self.most = max(map(len, self.items), default=0)
        self.steps = rng.integers(1, 2**63, (WALKS, STRETCH * self.most + 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.picks = np.sort(rng.random((max(SAMPLES), PICKED)), axis=1)
        self.runs = defaultdict(dict)
        for k, x in enumerate(self.items):
            q = run_length(len(x))
            for o in range(len(x) - q + 1):
                self.runs[q].setdefault(tuple(x[o : o + q]), []).append((k, o))
        self.grams = {q: np.unique(self._gram_keys([np.array(g) for g in found], q)) for q, found in self.runs.items()}
        self.places = [places(x) for x in self.items]
        self.by_class = defaultdict(list)
        for k, x in enumerate(self.items):
            self.by_class[size_class(len(x))].append(k)
        #: class to its number of samples (0: every window that passes the runs is checked) and tables of keys
        self.samples = {c: samples or self._calibrated(own, recall) for c, own in self.by_class.items()}
        self.tables = {}
        for c, own in self.by_class.items():
            keys = self.keys([self.items[k] for k in own], self.samples[c])
            orders = [np.argsort(keys[:, s], kind="stable") for s in range(self.samples[c])]
            self.tables[c] = [(keys[o, s], np.array(own)[o]) for s, o in enumerate(orders)]
        self.by_size = defaultdict(list)
        for k, x in enumerate(self.items):
            self.by_size[len(x)].append(k)

    def _gram_keys(self, rows, q):
        x = np.stack(rows) if len(rows) else np.zeros((0, q), np.int64)
        return self.rolled(x.T)

    def rolled(self, columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ self.symbols[c]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def keys(self, windows: list, samples: int) -> np.ndarray:
        """A key of each window for each sample: of its size and of the words at the sample's positions of its walk."""
        out, by_size = np.zeros((len(windows), samples), np.uint64), defaultdict(list)
        for r, w in enumerate(windows):
            by_size[len(w)].append(r)
        for n, rows in by_size.items():
            many = max(1, WORDS_AT_ONCE // n)
            for lo in range(0, len(rows), many):
                some = rows[lo : lo + many]
                out[some] = self._keyed(np.array([windows[r] for r in some], np.int64), samples)
        return out

    def _keyed(self, x: np.ndarray, samples: int) -> np.ndarray:
        """Keys of windows of one size. Of a walk only the words at the picked steps are kept."""
        n = x.shape[1]
        x = np.concatenate([x, np.full((len(x), 1), -1, np.int64)], axis=1)
        row, out = np.arange(len(x)), np.empty((len(x), samples), np.uint64)
        picks = (self.picks[:samples] * (STRETCH * n)).astype(np.int64)
        for e in range(min(WALKS, samples)):
            own = range(e, samples, WALKS)
            steps = sorted({int(p) for k in own for p in picks[k]})
            at, seen, wanted = np.zeros(len(x), np.int64), {}, set(steps)
            for j in range(steps[-1] + 1):
                s = self.symbols[x[row, at]]
                if j in wanted:
                    seen[j] = s
                at += (((s * self.steps[e, j]) >> np.uint64(63)) == 1) & (at < n)
            for k in own:
                key = np.full(len(x), n, np.uint64)
                for p in picks[k]:
                    key = (key ^ seen[int(p)]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key ^= key >> np.uint64(31)
                out[:, k] = key
        return out

    def _calibrated(self, own: list[int], recall: float) -> int:
        """The least number of samples that finds this share of random edits of the items own at the largest distance; 0 if none.

        An edit replaces a word, or drops one and adds one, which counts as two, so that each edited window has the item's
        size and is within the distance.
        """
        rng, size, pairs = random.Random(7), len(self.vocabulary), []
        for _ in range(TRIALS):
            x = self.items[rng.choice(own)]
            y, left = list(x), allowed(len(x))
            while left:
                if left > 1 and rng.random() < 0.5:
                    del y[rng.randrange(len(y))]
                    y.insert(rng.randrange(len(y) + 1), rng.randint(0, size))
                    left -= 2
                else:
                    y[rng.randrange(len(y))] = rng.randint(0, size)
                    left -= 1
            pairs.append((x, y))
        same = self.keys([x for x, _ in pairs], max(SAMPLES)) == self.keys([y for _, y in pairs], max(SAMPLES))
        return next((s for s in SAMPLES if same[:, :s].any(axis=1).mean() >= recall), 0)

    def met(self, windows: list) -> set[tuple[int, int]]:
        """(window, item) pairs that agree on a sample of their class, or all of one size where the class has no samples."""
        found, by_class = set(), defaultdict(list)
        for w, x in enumerate(windows):
            by_class[size_class(len(x))].append(w)
        for c, own in by_class.items():
            if not self.samples.get(c):
                found.update((w, k) for w in own for k in self.by_size.get(len(windows[w]), ()))
                continue
            keys = self.keys([windows[w] for w in own], self.samples[c])
            for s, (table, items) in enumerate(self.tables[c]):
                lo, hi = np.searchsorted(table, keys[:, s], "left"), np.searchsorted(table, keys[:, s], "right")
                for i in np.nonzero(hi > lo)[0].tolist():
                    found.update((own[i], int(k)) for k in items[lo[i] : hi[i]])
        return found

    def starts(self, ids: np.ndarray) -> dict[int, set[int]]:
        """size to starts of the windows of a text (word numbers) that share a run with an item of that size."""
        out = defaultdict(set)
        for q, table in self.grams.items():
            if len(ids) < q:
                continue
            n = len(ids) - q + 1
            full = np.ones(n, bool)
            for j in range(q):
                full &= ids[j : j + n] > 0
            p = np.nonzero(full)[0]
            if not len(p):
                continue
            keys = self.rolled([ids[p + j] for j in range(q)])
            slot = np.searchsorted(table, keys)
            hit = table[np.minimum(slot, len(table) - 1)] == keys
            for at in p[hit].tolist():
                for k, o in self.runs[q].get(tuple(ids[at : at + q].tolist()), ()):
                    size = len(self.items[k])
                    t = allowed(size)
                    out[size].update(range(max(at - o - t, 0), min(at - o + t, len(ids) - size) + 1))
        return out


def _matched(items: Items, keys: list[str]):
    def run(batches):
        names = [*keys, "item", "start", "n_words", "distance"]

        def flush(wanted, rows):
            """wanted: (row, size, starts, ids of the text); rows: the key columns of the batch that rows point into."""
            distinct, place = {}, defaultdict(list)
            for r, size, start, w in wanted:
                place[distinct.setdefault(w, len(distinct))].append((r, size, start))
            windows, best = list(distinct), {}
            for w, k in sorted(items.met([list(x) for x in windows])):
                x = items.items[k]
                d = edit_distance(x, windows[w], allowed(len(x)), items.places[k])
                if d <= allowed(len(x)):
                    for r, size, start in place[w]:
                        if (r, k) not in best or (d, start) < best[r, k][:2]:
                            best[r, k] = d, start, size
            found = sorted((r, k, *v) for (r, k), v in best.items())
            take = pa.array([f[0] for f in found], pa.int64())
            cols = [c.take(take) for c in rows]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in ([f[1] for f in found], [f[3] for f in found], [f[4] for f in found], [f[2] for f in found]))], names=names)

        get = items.vocabulary.get
        for batch in batches:
            rows, wanted = [batch.column(k) for k in keys], []
            texts = batch.column("text").cast(pa.binary())
            for r in range(len(texts)):
                raw = texts[r].as_py()
                if not raw:
                    continue
                w = raw.lower().split()
                ids = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
                for size, starts in items.starts(ids).items():
                    wanted += [(r, size, s, tuple(ids[s : s + size].tolist())) for s in sorted(starts)]
                # a text's windows stay together, so that the best of each item is the best of the text
                if len(wanted) >= FLUSH:
                    yield flush(wanted, rows)
                    wanted = []
            if wanted:
                yield flush(wanted, rows)

    return run


def _blocks(benchmark: DataFrame):
    """Items in order of item_id, a bounded block at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len((r.text or "").split())
        if len(held) >= BLOCK or size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, keys: list[str], recall: float = RECALL) -> DataFrame:
    """keys, item_id, start (word number), n_words, distance: the window nearest to each item that a row of docs leaks.

    benchmark: item_id, text.
    """
    spark = docs.sparkSession
    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    kind = T.StructType([rows.schema[k] for k in keys]).add("item", "long").add("start", "long").add("n_words", "long").add("distance", "long")
    item_type = benchmark.schema["item_id"].dataType
    out = []
    for block in _blocks(benchmark):
        items = Items(block, recall=recall)
        if items.items:
            numbers = spark.createDataFrame(list(enumerate(items.ids)), T.StructType().add("number", "long").add("item_id", item_type))
            found = rows.mapInArrow(_matched(items, keys), kind)
            # numbers has BLOCK rows at most
            out.append(found.join(F.broadcast(numbers), found["item"] == numbers["number"]).select(*(found[k] for k in keys), "item_id", "start", "n_words", "distance"))
    if not out:
        return rows.where("false").select(*keys, F.lit(None).cast(item_type).alias("item_id"), *(F.lit(None).cast("long").alias(c) for c in ("start", "n_words", "distance")))
    return reduce(DataFrame.unionAll, out)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, n_words and distance of every leak of every item in whole texts; null texts leak nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
