import random
import re

import numpy as np
import pytest
import xxhash

from quillon.llm import components, simhash

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = W.findall(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    """(doc_id, fingerprint) to the smallest doc_id reachable; rows: (doc_id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.nonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius)[0]:
            root[find(fps[i + 1 + int(j)])] = find(f)
    least = {}
    for d, f in rows:
        least[find(f)] = min(least.get(find(f), d), d)
    return {(d, f): least[find(f)] for d, f in rows}


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One two", "A b\x0bC", "a b c d", "É é ſ K", "x\x1cy z w v"] + [" ".join(rng.choice("abcdeFGH") for _ in range(rng.randint(3, 400))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as fp", "2 as tile")
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(df, ["doc_id"]).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("blocks,radius,most", [(4, 2, None), (8, 2, None), (4, 4, None), (2, 5, None), (4, 2, 5), (2, 3, 40)])
def test_components_of_random_and_clustered_prints(spark, monkeypatch, blocks, radius, most):
    """With most, tiles of more fingerprints than that are dealt in slices."""
    if most:
        monkeypatch.setattr(simhash, "SLICE", most)
    rng = random.Random(blocks)
    rows, seeds = [], [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    for s in seeds:
        f = s
        for _ in range(rng.choice([1, 1, 3, 40])):
            rows.append((rng.randint(0, 10**6), f))
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
    rows += [(rng.randint(0, 10**6), 1 << rng.randrange(64) | 1 << rng.randrange(64)) for _ in range(1500)]
    df = spark.createDataFrame([(d, f - 2**64 if f >= 2**63 else f) for d, f in rows], "doc_id long, fp long")
    got = df.join(simhash.classes(df, radius, blocks), "fp").collect()
    want = brute_components(rows, radius)
    assert len(got) == len(rows)
    assert all(r.component_id == want[(r.doc_id, r.fp % 2**64)] for r in got)


@pytest.mark.parametrize("blocks", [2, 4, 8])
def test_tiles_of_columns_and_arrays_agree(spark, blocks):
    from pyspark.sql import functions as F

    fp = np.random.default_rng(1).integers(0, 2**64, 50, np.uint64)
    base = (64 // blocks + 1) ** np.arange(blocks)
    got = [r.t for r in spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp.view(np.int64))], "i int, fp long").orderBy("i").select(simhash._tile(F.col("fp"), blocks).alias("t")).collect()]
    assert got == (simhash._counts(fp, blocks) @ base).tolist()


def test_a_very_long_text_and_repeated_rows(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long.upper()), (1, long), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())
    want = brute_print(long)
    assert got == sorted([(1, want, 1), (1, want, 1), (2, want, 1), (3, brute_print("x" * 2_000_000), 3)])


def test_chain_components(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    e = [(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1000), (1001, 1002), (1002, 1001), (None, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1001: 1001, 1002: 1001}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "solo solo solo solo")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == [("7", "7"), ("None", "7"), ("None", "7"), ("None", "None")]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute_components(rows)
    got = simhash.op6_simhash(spark, d).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", want[i, f]) for i, f in rows)
