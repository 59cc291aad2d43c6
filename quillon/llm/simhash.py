"""SimHash near-dedup by tiled exact comparison.

Each text gets a 64-bit fingerprint. Equal fingerprints are one vertex, so copies never meet each other. Fingerprints are
dealt into tiles by their population counts, taken in each of several equal blocks of bits: the counts of two fingerprints
that differ in r bits differ by r in total at most, so only tiles whose counts differ by no more than that are compared;
all other pairs of tiles are skipped. Within a pair of tiles numpy compares all fingerprints by exclusive-or and bit counts.
A comparison yields a spanning forest of its links, which has the same components and no more links than fingerprints.

More blocks mean more and smaller tiles, and more neighbours to compare a tile with. Four blocks serve up to some ten
million different fingerprints, eight beyond. Counts crowd around their means, so tiles there are large: a tile of more than
SLICE fingerprints is cut into slices, and pairs of slices go to tasks of their own.

Defined results: a text without words has fingerprint 0; fewer words than a shingle are one shingle; null doc_ids keep
their row and never name a component unless there is no other (then it is null); repeated rows get equal results; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import settle
from quillon.llm.components import components

SEED = 42
SHINGLE, RADIUS = 3, 2
#: Bytes of texts that are worked on at a time, and fingerprints of a comparison's two sides.
CHUNK, SIDE = 4 << 20, (1024, 8192)
#: Fingerprints of a slice of a large tile, and a bound of the number of such tiles.
SLICE, LARGE = 1 << 15, 20_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Words of a wide fingerprint.
WORDS = 4
#: Bits by which wide fingerprints of sets of similarity ALIKE or more may differ: all in all, with a set of fewer than SMALL
#: elements, and in the first two words. A bit differs with a chance of 0.161 at most (0.188 with a small set), so a pair
#: differs by more with a chance of 0.00000002 at most (0.0000003). Sets of fewer than EQUAL elements each are alike if equal only.
ALIKE, WITHIN, WITHIN_SMALL, WITHIN_HALF, SMALL, EQUAL = 0.8, 76, 84, 48, 8, 9
#: Ratio of the sizes that one step of the deal holds, wide fingerprints of a slice (least, most), slices of a small table,
#: and fingerprints of a comparison's two sides.
STEP, WIDE_SLICE, SLICES, WIDE_SIDE = 1.02, (1 << 10, 1 << 16), 16, (64, 4096)
_KEYS = np.concatenate([np.zeros(1, np.uint64), np.random.default_rng(SEED + 1).integers(0, 2**64, WORDS - 1, np.uint64)])


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of h."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        some = h[at : at + (1 << 15)]
        bits += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def wide(h: np.ndarray) -> np.ndarray:
    """WORDS words: the bits that are set in over half of h, which is hashed anew for each word but the first."""
    bits = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), 255):  # what a byte can count
        some = h[at : at + 255, None] ^ _KEYS
        for _ in range(2):
            some[:, 1:] *= _SPREAD
            some[:, 1:] ^= some[:, 1:] >> np.uint64(32)
        bits += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, span: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text."""
    import xxhash

    w = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= span:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, w), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    n = len(w) - span + 1
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[span - 1 :])), np.uint64, n)
    return majority(h)


def _printed(span: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            prints = pa.array(np.fromiter((fingerprint(x.as_py() or b"", span) for x in texts), np.uint64, len(texts)).view(np.int64))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), prints], names=[*names, "fp"])

    return run


def fingerprints(docs: DataFrame, keys: list[str], span: int = SHINGLE) -> DataFrame:
    """keys and fp (the fingerprint's 64 bits as a long) of every row of docs."""
    from pyspark.sql import types as T

    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_printed(span), T.StructType([rows.schema[k] for k in keys]).add("fp", "long"))


def _counts(fp: np.ndarray, blocks: int) -> np.ndarray:
    width = 64 // blocks
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fp >> np.uint64(width * b)) & mask) for b in range(blocks)], 1).astype(np.int64)


def _moves(blocks: int, radius: int) -> np.ndarray:
    """All changes of the counts by radius in total at most, without the one that changes nothing."""
    found = {(0,) * blocks}
    for _ in range(radius):
        found |= {(*m[:b], m[b] + d, *m[b + 1 :]) for m in found for b in range(blocks) for d in (-1, 1)}
    return np.array(sorted(found - {(0,) * blocks}), np.int64)


def _tile(fp, blocks: int):
    """The tile of a fingerprint column, as _dealt has it."""
    width = 64 // blocks
    counts = (F.bit_count(F.shiftrightunsigned(fp, width * b).bitwiseAND(F.lit((1 << width) - 1))) for b in range(blocks))
    return sum((c.cast("long") * (width + 1) ** b for b, c in enumerate(counts)), F.lit(0).cast("long"))


def _dealt(blocks: int, radius: int, slices: dict[int, int]):
    """Each fingerprint for its own tile (side 0), and for each near tile with a smaller key (side 1).

    A tile of p slices is dealt into cells: (i, j), i <= j < p, of its own slices i and j, and (i, p + v) of its slice i and
    the slice v of the fingerprints from near tiles. Other tiles are one cell (0, 0).
    """

    def run(batches):
        moves = _moves(blocks, radius)
        width = 64 // blocks
        base = (width + 1) ** np.arange(blocks, dtype=np.int64)
        large = np.array(sorted(slices), np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 2048):
                some = fp[at : at + 2048]
                own = _counts(some, blocks)
                near = own[:, None, :] + moves[None]
                key, keys = own @ base, near @ base
                ok = ((near >= 0) & (near <= width)).all(2) & (keys < key[:, None])
                who, _ = np.nonzero(ok)
                tile, side = np.concatenate([key, keys[ok]]), np.concatenate([np.zeros(len(key), np.int8), np.ones(len(who), np.int8)])
                value = np.concatenate([some, some[who]])
                i = j = np.zeros(len(tile), np.int32)
                if len(large):
                    hot = np.isin(tile, large)
                    parts = [(tile[~hot], i[~hot], j[~hot], side[~hot], value[~hot])]
                    for t, s, v in zip(tile[hot].tolist(), side[hot].tolist(), value[hot]):
                        p = slices[t]
                        m = int((v * _SPREAD) >> np.uint64(40)) % p
                        cells = [(k, p + m, 1) for k in range(p)] if s else [(min(m, k), max(m, k), int(m > k)) for k in range(p)] + [(m, p + k, 0) for k in range(p)]
                        x = np.array(cells, np.int32)
                        parts.append((np.full(len(x), t), x[:, 0], x[:, 1], x[:, 2].astype(np.int8), np.full(len(x), v)))
                    tile, i, j, side, value = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tile, i, j, side, value.view(np.int64))], names=["tile", "i", "j", "side", "fp"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[np.ndarray]:
    """A spanning forest of the links between fingerprints of a and b: pairs of them."""
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    if not len(i):
        return []
    if len(i) <= len(a) + len(b):
        return [np.stack([a[i], b[j]], 1)]
    left, right = np.arange(len(a)), np.full(len(b), len(a))  # label: the first of a that is reached
    while True:
        new = right.copy()
        np.minimum.at(new, j, left[i])
        low = left.copy()
        np.minimum.at(low, i, new[j])
        if (low == left).all() and (new == right).all():
            break
        left, right = low, new
    x, y = np.unique(i), np.unique(j)
    return [np.stack([a[x], a[left[x]]], 1), np.stack([b[y], a[right[y]]], 1)]


def _linked(radius: int):
    """Rows by cell (tile, i, j), side 0 first: links within side 0 if i = j, and between the sides."""

    def pairs(a, b):
        for x in range(0, len(a), SIDE[0]):
            for y in range(0, len(b), SIDE[1]):
                yield from _forest(a[x : x + SIDE[0]], b[y : y + SIDE[1]], radius)

    def run(batches):
        cell, own, inside = None, [], True
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def out(found):
            p = np.concatenate(found)
            p = p[p[:, 0] != p[:, 1]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], schema=schema)

        def close():
            if len(own) and inside:
                all_own = np.concatenate(own)
                own[:] = [all_own]
                for k in range(0, len(all_own), SIDE[0]):
                    yield from pairs(all_own[k : k + SIDE[0]], all_own[k:])

        for batch in batches:
            t, i, j, s, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "i", "j", "side", "fp"))
            cuts = [0, *(np.nonzero(np.any([x[1:] != x[:-1] for x in (t, i, j, s)], axis=0))[0] + 1).tolist(), len(t)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                some = fp[lo:hi].view(np.uint64)
                found = []
                if (t[lo], i[lo], j[lo]) != cell:
                    found += close()
                    cell, inside = (t[lo], i[lo], j[lo]), i[lo] == j[lo]
                    own.clear()
                if s[lo] == 0:
                    own.append(some)
                else:
                    found += close()
                    inside = False
                    if own:
                        own[:] = [np.concatenate(own)]
                        found += pairs(own[0], some)
                if found:
                    yield out(found)
        found = list(close())
        if found:
            yield out(found)

    return run


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Edges a, b between different fingerprints of prints (fp, distinct): those of all pairs within radius bits have the
    same components as these, and these are within radius bits or in one component of a comparison."""
    n = prints.count()
    if blocks is None:
        blocks = 4 if n <= 20_000_000 else 8
    # a tile above this is dealt in cells; fewer than LARGE can be, so their sizes fit the driver
    most = max(SLICE, n // LARGE)
    large = prints.groupBy(_tile(F.col("fp"), blocks).alias("tile")).count().where(F.col("count") > most).collect()
    slices = {r["tile"]: -(-r["count"] // SLICE) for r in large}
    dealt = prints.select("fp").mapInArrow(_dealt(blocks, radius, slices), "tile long, i int, j int, side byte, fp long")
    ranked = dealt.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "side")
    return ranked.mapInArrow(_linked(radius), "a long, b long")


def _sliced(sizes: list[tuple[int, int, int, int]], most: int, similarity: float):
    """Slices of steps (step, rows, least and largest size): (first slice, slices) by step, and of each slice the first and
    last slice that can hold sets similar to its own."""
    where, lo, hi, free = {}, [], [], 0
    for step, n, low, high in sorted(sizes):
        parts = -(-n // most)
        if n <= free:
            where[step] = (len(lo) - 1, 1)
            hi[-1], free = high, free - n
        else:
            where[step] = (len(lo), parts)
            lo += [low] * parts
            hi += [high] * parts
            free = most - n if parts == 1 else 0
    least = np.array(lo) * (similarity - 1e-9)
    return where, np.searchsorted(hi, least), np.searchsorted(least, hi, side="right") - 1


def _wide_dealt(where: dict[int, tuple[int, int]], first: np.ndarray, last: np.ndarray):
    """Each fingerprint for the cells (i, j), i <= j, of its slice and those that can hold similar sets; side 1 if its own is j > i."""

    def run(batches):
        steps = np.array(sorted(where), np.int64)
        start, parts = (np.array([where[s][k] for s in steps.tolist()], np.int64) for k in (0, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                step = np.searchsorted(steps, some.column("step").to_numpy(zero_copy_only=False))
                spread = np.array([int.from_bytes(x[:8], "little") for x in some.column("node").to_pylist()], np.uint64)
                own = start[step] + (spread % parts[step].astype(np.uint64)).astype(np.int64)
                n = last[own] - first[own] + 1
                who = np.repeat(np.arange(len(own)), n)
                other = first[own][who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                cell = [np.minimum(own[who], other), np.maximum(own[who], other), (other < own[who]).astype(np.int8)]
                held = some.select(["node", "print", "size"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cell), *held.columns], names=["i", "j", "side", "node", "print", "size"])

    return run


def _wide_forest(a: dict, b: dict, inside: bool, similarity: float):
    """A spanning forest of the links between fingerprints (print, size) of a and b, or within a: places in a, places in b."""
    a, b = ({k: v[o] for k, v in s.items()} | {"at": o} for s in (a, b) for o in [np.argsort(s["size"], kind="stable")])
    n, m, words, past = a["size"], b["size"], np.ascontiguousarray(b["print"].T), 0 if inside else len(a["size"])
    label, found, close = np.arange(len(n) + (0 if inside else len(m))), [], similarity - 1e-9
    held = np.empty(WIDE_SIDE[0] * WIDE_SIDE[1], np.uint64)
    for x in range(0, len(n), WIDE_SIDE[0]):
        own = a["print"][x : x + WIDE_SIDE[0]]
        low, high = np.searchsorted(m, n[x] * close), np.searchsorted(m, n[x + len(own) - 1] / close, side="right")
        for y in range(max(low, x) if inside else low, high, WIDE_SIDE[1]):
            z = min(y + WIDE_SIDE[1], high)
            cells = held[: len(own) * (z - y)].reshape(len(own), z - y)
            bits = np.bitwise_count(np.bitwise_xor(own[:, :1], words[0, y:z], out=cells))
            bits += np.bitwise_count(np.bitwise_xor(own[:, 1:2], words[1, y:z], out=cells))
            at = np.flatnonzero(bits <= WITHIN_HALF)
            if not len(at):
                continue
            i, j = at // (z - y) + x, at % (z - y) + y
            left = label[i] != label[j + past]
            i, j, apart = i[left], j[left], bits.ravel()[at[left]].astype(np.int64)
            for w in range(2, WORDS):
                apart += np.bitwise_count(a["print"][i, w] ^ words[w, j])
            least, most = np.minimum(n[i], m[j]), np.maximum(n[i], m[j])
            ok = (apart <= np.where(least < SMALL, WITHIN_SMALL, WITHIN)) & (least >= close * most) & ((most >= EQUAL) | (least < most) | (apart == 0))
            i, j = i[ok], j[ok]
            while len(i):  # each root but the least of a link hangs on a lesser one
                r, s = label[i], label[j + past]
                up, one = np.unique(np.maximum(r, s), return_index=True)
                found.append((a["at"][i[one]], b["at"][j[one]]))
                parent = np.arange(len(label))
                parent[up] = np.minimum(r, s)[one]
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                label = parent[label]
                left = label[i] != label[j + past]
                i, j = i[left], j[left]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _wide_linked(similarity: float):
    """Rows by cell (i, j), side 0 first: links a, b within side 0 if i = j, and between the sides."""

    def run(batches):
        cell, sides = None, ([], [])

        def close():
            inside = cell is not None and cell[0] == cell[1]
            if sides[0] and (inside or sides[1]):
                both = [{k: np.concatenate([p[k] for p in parts]) for k in parts[0]} for parts in (sides[0], sides[0] if inside else sides[1])]
                i, j = _wide_forest(*({k: s[k] for k in ("print", "size")} for s in both), inside, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]["node"][i], pa.binary()), pa.array(both[1]["node"][j], pa.binary())], names=["a", "b"])

        for batch in batches:
            i, j, side, size = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("i", "j", "side", "size"))
            node = np.array(batch.column("node").to_pylist(), object)
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, WORDS)
            cuts = [0, *(np.nonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (side[1:] != side[:-1]))[0] + 1).tolist(), len(i)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if (i[lo], j[lo]) != cell:
                    yield from close()
                    cell, sides = (i[lo], j[lo]), ([], [])
                sides[side[lo]].append({"node": node[lo:hi], "print": prints[lo:hi], "size": size[lo:hi]})
        yield from close()

    return run


def wide_links(prints: DataFrame, similarity: float = ALIKE) -> DataFrame:
    """Edges a, b between nodes of prints (node: a digest, print: wide, size: of the set): all pairs whose sizes allow the similarity and
    whose fingerprints are as near as those of similar sets have the same components as these, each of which is such a pair.

    Tiles are ranges of sizes, as many sizes differ too much; all fingerprints of near tiles meet by exclusive-or and bit counts.
    """
    if similarity < ALIKE:
        raise ValueError(f"the bits hold for similarities of {ALIKE} or more")
    rows = prints.where("size > 0").withColumn("step", F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(STEP))).cast("long"))
    # one row for each step: a few thousand at most, whatever the sizes
    sizes = [tuple(r) for r in rows.groupBy("step").agg(F.count("*"), F.min("size"), F.max("size")).collect()]
    most = min(max(sum(n for _, n, _, _ in sizes) // SLICES, WIDE_SLICE[0]), WIDE_SLICE[1])
    where, first, last = _sliced(sizes, most, similarity)
    cells = int((last - np.arange(len(last)) + 1).sum())
    dealt = rows.mapInArrow(_wide_dealt(where, first, last), "i long, j long, side byte, node binary, print binary, size long")
    ranked = dealt.repartition(min(max(cells, 1), 4096), "i", "j").sortWithinPartitions("i", "j", "side")
    return ranked.mapInArrow(_wide_linked(similarity), "a binary, b binary")


def classes(rows: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """fp, component_id (the smallest doc_id that rows reach from fp) for each fingerprint of rows (doc_id, fp)."""
    first = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    member = components(links(first, radius, blocks))
    joined = first.join(member, first["fp"] == member["node"], "left").select(first["fp"], "least", "root")
    smallest = joined.where("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    out = joined.join(smallest, "root", "left")
    return settle(out.select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, span: int = SHINGLE, blocks: int | None = None) -> DataFrame:
    """doc_id, fp and component_id of every row of docs."""
    rows = settle(fingerprints(docs, ["doc_id"], span), "simhash")
    return rows.join(classes(rows, radius, blocks), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null and empty texts have fingerprint zero."""
    done = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
