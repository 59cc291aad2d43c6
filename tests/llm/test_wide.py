"""The pipeline's near-dedup meets texts by op6's operator: tiled comparison of SimHash fingerprints."""

import random

import corpus_pipeline as P
import numpy as np
import pytest
from test_nearcopies import brute_groups, edited, found, partition

from quillon.llm import nearcopies, simhash
from quillon.llm.components import components


def test_similar_pairs_without_shared_minima(spark):
    """Pairs at 0.8 that share none of the 24 minima of the tiles that the stage had before."""
    rows = []
    for at in (432862, 437843, 481829, 694683, 988324):
        words = [f"w{i}" for i in range(at, at + 9)]
        rows += [(2 * at, " ".join(words)), (2 * at + 1, " ".join(words[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source", "1L as n_chars")
    assert {r.doc_id for r in P.near_dedup(spark, docs, "").collect()} == {k for k, _ in rows if k % 2 == 0}


def test_groups_come_by_fingerprints(spark, monkeypatch):
    """Without links between fingerprints no different texts are one group."""
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "A b c d e f g h i j k l")]
    assert found(spark, rows) == {frozenset({1, 2, 3})}
    none = spark.createDataFrame([], "a binary, b binary")
    monkeypatch.setattr(nearcopies, "wide_links", lambda *_: none)
    assert found(spark, rows) == {frozenset({1, 3}), frozenset({2})}


def sets(rng):
    """Random sets and some that lack or change a few elements of another."""
    out = []
    for n in [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 12, 13, 40, 41, 200, 200, 900] * 4:
        one = rng.integers(0, 2**64, n, np.uint64)
        out += [one, one[: max(n - max(n // 9, 1), 1)], np.concatenate([one[n // 12 :], rng.integers(0, 2**64, n // 12, np.uint64)]), one[: n // 2 + 1]]
    return out


def brute_links(prints, sizes):
    """Places of pairs whose sizes allow 0.8 and whose fingerprints are near enough, one pair at a time."""
    ints = [int.from_bytes(p, "little") for p in prints]
    for i in range(len(ints)):
        for j in range(i):
            x, (n, m) = ints[i] ^ ints[j], sorted((sizes[i], sizes[j]))
            near = x.bit_count() <= (84 if n < 8 else 76) and (x & (2**128 - 1)).bit_count() <= 48
            if near and n >= 0.8 * m and (m >= 9 or n < m or not x):
                yield i, j


@pytest.mark.parametrize("slices", [(1 << 10, 1 << 16), (3, 7)])
def test_links_against_all_pairs(spark, monkeypatch, slices):
    monkeypatch.setattr(simhash, "WIDE_SLICE", slices)
    held = sets(np.random.default_rng(8))
    prints, sizes = [simhash.wide(h).tobytes() for h in held], [len(h) for h in held]
    nodes = [bytes([i // 256, i % 256]) * 8 for i in range(len(held))]
    df = spark.createDataFrame([(bytearray(n), bytearray(p), s) for n, p, s in zip(nodes, prints, sizes)], "node binary, print binary, size long")
    root = list(range(len(held)))
    pairs = list(brute_links(prints, sizes))
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    links = [(nodes.index(bytes(r.a)), nodes.index(bytes(r.b))) for r in simhash.wide_links(df).collect()]
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in pairs}
    edges = spark.createDataFrame([(bytearray(nodes[i]), bytearray(nodes[j])) for i, j in links], "a binary, b binary")
    got = {nodes.index(bytes(r.node)): nodes.index(bytes(r.root)) for r in components(edges).collect()}
    assert {k: got.get(k, k) for k in range(len(held))} == dict(enumerate(root))


def test_wide_bits():
    rng = np.random.default_rng(9)
    for n in (1, 2, 254, 255, 256, 700):
        h = rng.integers(0, 2**64, n, np.uint64)
        w = simhash.wide(h)
        assert len(w) == simhash.WORDS and int(w[0]) == simhash.majority(h)
    assert not simhash.wide(h[:0]).any()
    with pytest.raises(ValueError):
        simhash.wide_links(None, 0.5)


def test_slices_hold_all_near_sizes():
    rng = random.Random(2)
    sizes = [(s, rng.choice([1, 5, 40]), 2 * s + 1, 2 * s + 2) for s in range(60)]
    where, first, last = simhash._sliced(sizes, 12, 0.8)
    for s, _, lo, _ in sizes:
        for t, _, _, hi in sizes:
            if t <= s and hi >= 0.8 * lo:
                for x in range(where[t][0], sum(where[t])):
                    for y in range(where[s][0], sum(where[s])):
                        assert first[y] <= x <= last[y] and first[x] <= y <= last[x]


def test_chain_of_classes(spark):
    """Texts below the bound that a chain of near fingerprints connects stay apart."""
    rng = random.Random(11)
    words, rows = [f"w{rng.randrange(10**6)}" for _ in range(300)], []
    for i in range(8):
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(edited(rng, words, 2))), (3 * i + 2, " ".join(words[:200]))]
        words = edited(rng, words, 12)
    assert found(spark, rows) == partition(brute_groups(rows).items())
