import random
import re

import pytest

from quillon.llm import mixing

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = dict(zip(names, mixing.weigh_in_turn(len(names), weights)))
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left, rest = total - sum(out.values()), sum(w[s] for s in free)
        over = {s for s in free if w[s] * left / rest > most * sizes[s]}
        if not over:
            out |= {s: w[s] * left / rest for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def check(spark, rows, near):
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(W.findall(t or ""))
    want = brute_targets(sizes)
    by_doc = {}
    for d, t, s in rows:
        by_doc.setdefault((d, len(W.findall(t or "")), sizes[s]), []).append(s)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        (s, *_) = by_doc[(r.doc_id, r.size, r.source_size)]
        assert r.target == pytest.approx(want[s]) and r.taken in {0, r.size, 2 * r.size}
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(sizes[s], want[s]), (s, taken[s], want[s])
    return sorted(map(tuple, got), key=str)


def test_random_sources(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(["a", "é", "b", "𝄞", None, "z"] + ["hot"] * 4)) for i in range(600)]
    assert check(spark, rows, lambda s, t: 100) == check(spark, rows[::-1], lambda s, t: 100)


def test_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(None, None, None), (1, "", "a"), (1, "one two", "a"), (1, "one two", "a"), (2, "x y\x0bz " * 3000, "b"), (3, "q", "c")]
    check(spark, rows, lambda s, t: s)
    wide = frame(spark, rows).selectExpr("*", "1 as size", "2 as hash", "3 as need", "4 as target", "5 as edge")
    assert mixing.mix(wide).count() == len(rows)
    assert all(r.taken == 0 for r in mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect())


def test_query(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = mixing.op3_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    most = max(len(W.findall(r[1] or "")) for r in rows)
    check(spark, rows, lambda s, t: most / 2)
