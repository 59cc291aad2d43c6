import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quillon.llm import substrings

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=35):
    split = [W.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = {j for i in range(len(w) - length + 1) if n[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [[word() for _ in range(rng.choice([34, 35, 36, 60, 200]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [word() for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.4:
                s = rng.choice(shared)
                cut = rng.randint(0, 3)
                w += s[cut:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, "z " * 34), (1003, "y " * 35), (1004, "x " * 36), (1005, rows[0][1]), (1005, rows[0][1]), (None, " ".join(shared[4])), (1006, "v\x1cw " * 40), (1007, " ".join(word() for _ in range(30000)))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as ord", "3 as kept", "4 as n_words")
    got = substrings.dedup(df, ["doc_id"]).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_other_lengths(spark):
    rows = corpus(3, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.dedup(df, ["doc_id"], length=8, period=7, cover=(0, 1, 3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 8)
    with pytest.raises(AssertionError):
        substrings.dedup(df, ["doc_id"], cover=(0, 1, 4))


def test_runs_across_batches():
    row = lambda *r: pa.RecordBatch.from_arrays([pa.array([x]) for x in r], names=["p", "q", "k", "at", "sure"])
    rows = [(1, 0, 10, 0, 0), (1, 0, 11, 0, 0), (1, 0, 12, 0, 0), (2, 0, 13, 0, 0), (2, 1, 14, 0, 0), (3, 0, 15, 0, 1), (4, 0, 16, 0, 2), (5, 0, 17, 0, 2), (5, 0, 18, 0, 0)]
    got = [k for b in substrings._repeated(row(*r) for r in rows) for k in b.column("k").to_pylist()]
    assert sorted(got) == [10, 11, 12, 15, 16, 17, 18]


def test_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, substrings.op2_substring_dedup(spark, d).collect()), key=str) == brute(rows)
