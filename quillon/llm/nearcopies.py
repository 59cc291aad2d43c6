"""Near copies by similarity: tiled exact comparison of wide SimHash fingerprints, then an exact check.

Fingerprints of 64 bits alone can't tell texts of similarity 0.8: these differ in some ten bits, and up to twenty, as some
unlike ones do. So op6's operator compares fingerprints of 256 bits, all with all whose sizes allow the similarity
(simhash.wide_links), by exclusive-or and bit counts; the components of its links are classes, and no similar pair lies in
two (but for a chance of 0.0000003 at most, see there). Within a class the pairs are checked on their sets of shingles.

Texts with the same words (lower-cased A-Z) are one node. In each class all nodes first meet one leader; nodes whose
components then differ meet the leaders of the outermost components; only what still differs is compared pair by pair, in
blocks, so that a class of copies of one text costs one check for each of them and no pair of places is formed.

Defined results: texts without words are copies of each other; fewer words than a shingle are one shingle; nulls count as
empty texts; repeated rows get equal results; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._common import at_keys, settle
from quillon.llm.components import components
from quillon.llm.simhash import SEED, wide, wide_links
from quillon.sources.stored import prefixed

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which the first words of similar sets' fingerprints may differ: ten are expected at 0.8, with a deviation of three, and
#: more than RADIUS have a chance of 0.000000002. Sets of fewer than SMALL shingles, whose bits vary more, are checked whatever these.
RADIUS, SMALL = 30, 8
#: Checks of a leader in one group, members of a block, and rounds of leaders before pairs are compared in blocks.
CHECKS, BLOCK, LEADERS = 128, 256, 2
#: Bytes of sets that a block holds.
SET_BYTES = 32 << 20
#: Keys of rows that may be broadcast (a key and a digest each); with more, texts are shuffled to them.
BROADCAST_KEYS = 100_000

_RNG = np.random.default_rng(SEED)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte (the same for A-Z and a-z), and the factor between neighbouring bytes of a word.
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _RNG.integers(0, 2**64, None, np.uint64) | np.uint64(1)
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits of each word of a UTF-8 text, A-Z lower-cased; array operations only."""
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):  # pieces end between words
            m = _BLANK.search(text, end)
            end = m.start() if m else len(text)
        b = np.frombuffer(text, np.uint8, end - at, at)
        at = end
        solid = ~_SPACE[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        c = b[solid]
        starts = np.nonzero(first[solid])[0]
        if not len(starts):
            continue
        sizes = np.diff(starts, append=len(c))
        powers = np.full(int(sizes.max()), _STEP, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        h = np.add.reduceat(_BYTE[c] * powers[np.arange(len(c)) - np.repeat(starts, sizes)], starts)
        h = (h ^ sizes.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(32)
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])]


def shingle_set(text: bytes, span: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """A digest of the words of a UTF-8 text, and the distinct hashes of its shingles, sorted."""
    import xxhash

    node = xxhash.xxh3_128_digest(b" ".join(text.lower().split()), SEED)  # of bytes: A-Z and ASCII white space only
    h = word_hashes(text)
    if not len(h):
        return node, h
    k = min(span, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(32)
    return node, _distinct(out)


def _sketched(span: int):
    def run(batches):
        for batch in batches:
            nodes, prints, sizes = [], [], []
            for x in batch.column("text").cast(pa.binary()):
                node, h = shingle_set(x.as_py() or b"", span)
                nodes.append(node)
                prints.append(wide(h).tobytes())
                sizes.append(len(h))
            names = [n for n in batch.schema.names if n != "text"]
            fps = pa.array([np.frombuffer(x, np.int64, 1)[0] for x in prints], pa.int64())
            new = [pa.array(nodes, pa.binary()), fps, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, "node", "fp", "size", "print"])

    return run


def _setted(span: int):
    """Sets of shingles as sorted 32-bit hashes: a false match needs a collision among the shingles of two texts."""

    def run(batches):
        for batch in batches:
            nodes, texts = batch.column("node"), batch.column("text").cast(pa.binary())
            for at in range(0, len(nodes), 64):
                sets = [_distinct((shingle_set(x.as_py() or b"", span)[1] >> np.uint64(32)).astype(np.uint32)).tobytes() for x in texts[at : at + 64]]
                yield pa.RecordBatch.from_arrays([nodes[at : at + 64], pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def _alike(n: str, m: str, similarity: float):
    return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m)


def _checked(similarity: float):
    """Rows by a and salt, the leader's own set first: the pairs whose sets are similar."""

    def run(batches):
        leader, its = None, None
        for batch in batches:
            a, b = [], []
            for who, side, node, hashes in zip(*(batch.column(n) for n in ("a", "side", "b", "hashes"))):
                who, some = who.as_py(), np.frombuffer(hashes.as_buffer(), np.uint32)
                if side.as_py() == 0:
                    leader, its = who, some.copy()
                    continue
                if who != leader:
                    raise RuntimeError("a leader's set is missing")
                common = len(np.intersect1d(its, some, assume_unique=True))
                if common >= similarity * (len(its) + len(some) - common):
                    a.append(who)
                    b.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def check(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets (node, hashes) are similar. A leader's set goes once to each CHECKS of its pairs."""
    counts = settle(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CHECKS).cast("int").alias("salts")), "leaders")
    held = sets.select(F.col("node"), "hashes")
    lead = counts.join(held, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("b"), "hashes")
    others = at_keys(pairs, counts, "a").join(held, F.col("b") == F.col("node")).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "b", "hashes")
    met = lead.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return settle(met.mapInArrow(_checked(similarity), "a binary, b binary"), "similar")


def _linked(radius: int, similarity: float):
    """Rows by tile (band: a class, i, j), side 0 first: a forest of the similar pairs of different roots, each checked on its sets.

    A pair whose roots the tile has linked already is not compared, so no tile yields more links than it has nodes.
    """

    def pairs(x, y):
        x, y = ({k: v[o] for k, v in s.items()} for s in (x, y) for o in [np.argsort(np.bitwise_count(s["fp"]), kind="stable")])
        px, py = np.bitwise_count(x["fp"]).astype(int), np.bitwise_count(y["fp"]).astype(int)
        label = np.arange(max(x["root"].max(), y["root"].max()) + 1)  # root to the root it is linked to
        most = SMALL / similarity  # a set of this size is alike to none that is small
        a, b = [], []
        for u in range(len(px)):
            lo, hi = np.searchsorted(py, [px[u] - radius, px[u] + radius + 1]) if x["size"][u] >= most else (0, len(py))
            n, m = x["size"][u], y["size"][lo:hi]
            ok = ((np.bitwise_count(x["fp"][u] ^ y["fp"][lo:hi]) <= radius) | (np.minimum(n, m) < SMALL)) & (np.minimum(n, m) >= similarity * np.maximum(n, m))
            left = lo + np.nonzero(ok & (label[y["root"][lo:hi]] != label[x["root"][u]]))[0]
            its = x["hashes"][u]
            while len(left):
                some, left = left[:32], left[32:]
                sets = [y["hashes"][v] for v in some]
                all_ = np.concatenate(sets)
                at = np.minimum(np.searchsorted(its, all_), len(its) - 1)
                lens = np.array([len(s) for s in sets])
                common = np.add.reduceat((its[at] == all_).astype(np.int64), np.cumsum(lens) - lens)
                for v in some[common >= similarity * (len(its) + lens - common)]:
                    one, other = label[x["root"][u]], label[y["root"][v]]
                    if one != other:
                        label[label == other] = one
                        a.append(x["node"][u])
                        b.append(y["node"][v])
                left = left[label[y["root"][left]] != label[x["root"][u]]]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def joined(parts):
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def run(batches):
        tile, sides = None, ([], [])

        def close():
            if sides[0]:
                codes = {}
                both = [joined(parts) for parts in sides if parts]
                for s in both:
                    s["root"] = np.array([codes.setdefault(r, len(codes)) for r in s["root"]])
                if tile[1] == tile[2] or len(both) == 2:
                    yield from pairs(both[0], both[-1])

        for batch in batches:
            band, i, j, side = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("band", "i", "j", "side"))
            cells = {"fp": batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), "size": batch.column("size").to_numpy(zero_copy_only=False)}
            for n in ("node", "root"):
                cells[n] = np.array(batch.column(n).to_pylist(), object)
            cells["hashes"] = np.empty(len(band), object)
            for k, h in enumerate(batch.column("hashes")):
                cells["hashes"][k] = np.frombuffer(h.as_py(), np.uint32)
            cuts = np.nonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (side[1:] != side[:-1]))[0] + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(band)]):
                if lo == hi:
                    continue
                if (band[lo], i[lo], j[lo]) != tile:
                    yield from close()
                    tile, sides = (band[lo], i[lo], j[lo]), ([], [])
                sides[side[lo]].append({k: v[lo:hi] for k, v in cells.items()})
        yield from close()

    return run


def _in_blocks(mixed: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links a, b of mixed (band, node, fp, size, root): each tile in pairs of blocks of BLOCK nodes and SET_BYTES of sets.

    Pairs of blocks are numbered, those of the largest tiles first, and dealt to the tasks in turn.
    """
    parts = mixed.groupBy("band").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") * 4 / SET_BYTES)).cast("long").alias("parts"))
    parts = settle(parts.withColumns({"less": -F.col("parts"), "pairs": F.expr("parts * (parts + 1) div 2")}), "parts")
    parts = settle(prefixed(parts, ["less", "band"], {"pairs": "start"}).select("band", "n", "parts", "start"), "numbered")
    placed = at_keys(mixed, parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "band", "parts", "start", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "node", "fp", "size", "root"
    )
    tasks = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.expr("start + i * parts - i * (i - 1) div 2 + j - i"), F.lit(tasks)).cast("int")
    ranked = dealt.withColumn("turn", turn).drop("parts", "start").join(sets, "node").repartitionById(tasks, "turn").drop("turn").sortWithinPartitions("band", "i", "j", "side")
    return settle(ranked.mapInArrow(_linked(radius, similarity), "a binary, b binary"), "similar")


def groups(docs: DataFrame, key: str, carry: list[str] = [], span: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """key, the columns to carry, and group, of each row of docs: equal where a chain of similar texts connects the rows."""
    texts = docs.select(F.col(key).alias("key"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(carry)), F.col("text").cast("string").alias("text"))
    rows = settle(texts.mapInArrow(_sketched(span), T.StructType(texts.schema.fields[:-1]).add("node", "binary").add("fp", "long").add("size", "long").add("print", "binary")), "sketches")
    prints = settle(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "size", "print"))), "prints")
    classes = settle(components(wide_links(prints.select("node", "print", "size"), similarity)), "classes")
    shared = settle(prints.join(classes, "node").select(F.xxhash64("root").alias("band"), "node", "fp", "size"), "tiles")

    # one row of each text that shares a class stands for it in the checks; other texts are not hashed again
    chosen = rows.groupBy("node").agg(F.min("key").alias("key")).join(shared.select("node").distinct(), "node", "left_semi")
    chosen = settle(chosen.select("key", "node"), "chosen")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
    wanted = texts.select("key", "text").join(few, "key").dropDuplicates(["key"])
    sets = settle(wanted.mapInArrow(_setted(span), "node binary, hashes binary"), "sets")

    none = docs.sparkSession.createDataFrame([], "a binary, b binary")
    tried, edges, root_of = none, none, None
    for turn in range(LEADERS + 1):
        if root_of is None:
            mixed = shared.withColumn("root", F.col("node"))
        else:
            named = shared.join(root_of.select(F.col("node").alias("named"), F.col("root").alias("known")), F.col("node") == F.col("named"), "left")
            named = named.select("band", "node", "fp", "size", F.coalesce("known", "node").alias("root"))
            named = settle(named, "named")
            several = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
            mixed = settle(at_keys(named, settle(several.where("low < high").select("band", "n"), "several")).drop("n"), "mixed")
            if mixed.isEmpty():
                break
        if turn < LEADERS:
            who = F.struct("root", "node", "fp", "size")
            ends = settle(mixed.groupBy("band").agg(F.count("*").alias("n"), F.array(F.min(who), F.max(who)).alias("ends") if turn else F.array(F.min(who)).alias("ends")), "ends")
            met = at_keys(mixed, ends).withColumn("l", F.explode("ends")).where("root != l.root")
            met = met.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("l.fp"))) <= RADIUS) | (F.least("size", "l.size") < SMALL))
            pairs = met.where(_alike("size", "l.size", similarity)).select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()
            known = tried.union(tried.select("b", "a")).distinct()
            pairs = settle(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
            tried = tried.union(pairs)
            edges = edges.union(check(pairs, sets, similarity))
        else:
            edges = edges.union(_in_blocks(mixed, sets, RADIUS, similarity))
        root_of = settle(components(edges), "roots")
    kept = [F.col("key").alias(key), *(F.col(f"__{i}").alias(c) for i, c in enumerate(carry))]
    named = root_of.select(F.col("node").alias("named"), "root")
    return rows.join(named, F.col("node") == F.col("named"), "left").select(*kept, F.coalesce("root", "node").alias("group"))
