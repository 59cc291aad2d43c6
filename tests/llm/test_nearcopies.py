import random
import re

import pytest

from quillon.llm import _common, nearcopies

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_shingles(text):
    w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute_groups(rows, similarity=0.8):
    """(key, text) to the key of a group's first row, by all pairs of texts that share a shingle."""
    sets = {k: brute_shingles(t) for k, t in rows}
    root, by = {k: k for k in sets}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in sets.items():
        near = {x for g in s for x in by.get(g, ())} if s else {x for x in sets if not sets[x]}
        for x in near:
            if find(x) != find(k) and (not s or len(s & sets[x]) >= similarity * len(s | sets[x])):
                root[max(find(x), find(k))] = min(find(x), find(k))
        for g in s:
            by.setdefault(g, []).append(k)
    return {k: find(k) for k in sets}


def partition(pairs):
    held = {}
    for k, g in pairs:
        held.setdefault(g, set()).add(k)
    return {frozenset(s) for s in held.values()}


def found(spark, rows):
    df = spark.createDataFrame(rows, "k long, text string").selectExpr("*", "1 as node", "2 as size", "3 as band")
    return partition((r.k, bytes(r.group)) for r in nearcopies.groups(df, "k").collect())


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("leaders,block,checks", [(2, 2048, 512), (1, 16, 8), (0, 7, 4)])
def test_planted_copies(spark, monkeypatch, leaders, block, checks):
    """Far from the bound in either direction: chains, one large group, small groups, texts alike by less than the bound."""
    monkeypatch.setattr(nearcopies, "LEADERS", leaders)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "CHECKS", checks)
    rng = random.Random(5)
    texts = [None, "", " \t", "one", "ONE", "two words", "a b c d e", "a b c d f"]
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts += [" ".join(edited(rng, base, rng.randint(0, 3))) for _ in range(60)]
    for _ in range(12):
        some = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(some), " ".join(some).upper(), " ".join(edited(rng, some, 3)), " ".join(edited(rng, some, 25))]
    step = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for _ in range(6):
        texts.append(" ".join(step))
        step = edited(rng, step, 3)
    rows = list(enumerate(texts))
    assert found(spark, rows) == partition(brute_groups(rows).items())


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert found(spark, rows) == partition(brute_groups(rows).items())


def test_empty(spark):
    assert found(spark, []) == set()


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]
    assert found(spark, rows) == {frozenset({1, 2, None}), frozenset({None})}


def test_word_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(nearcopies, "PIECE", 50)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcXYZé0") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["w" * 200]
    text = "".join(w + rng.choice([" ", "\n", "\x0b\t", "  "]) for w in words).encode()
    h = nearcopies.word_hashes(b" " + text).tolist()
    w = text.lower().split()
    assert len(h) == len(w) and len(set(zip(w, h))) == len(set(w)) == len(set(h))
    assert not len(nearcopies.word_hashes(b"")) and not len(nearcopies.word_hashes(b" \n"))


def test_very_long_text(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(edited(rng, long, 2000))), (3, " ".join(edited(rng, long, 30_000))), (4, "x" * 2_000_000)]
    assert found(spark, rows) == {frozenset({1, 2}), frozenset({3}), frozenset({4})}


def test_texts_shuffled_to_many_keys(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(_common, "HOT_ROWS", 2)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.randint(0, 2))) for _ in range(30)))
    assert found(spark, rows) == partition(brute_groups(rows).items())


def test_pairs_at_the_bound(spark):
    """Pairs whose similarity is exactly 0.8, of four shingles on: none is lost."""
    rng = random.Random(7)
    rows = []
    for i in range(2000):
        n = rng.choice([4, 8, 12, 20, 40])
        words = [f"w{rng.randrange(10**9)}" for _ in range(n * 5 // 4 + 4)]
        rows += [(2 * i, " ".join(words[: n + 4])), (2 * i + 1, " ".join(words))]
    assert found(spark, rows) == {frozenset({2 * i, 2 * i + 1}) for i in range(2000)}
