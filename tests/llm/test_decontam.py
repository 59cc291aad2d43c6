import random

from quillon.llm import decontam as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def brute(docs, items):
    """(doc, item) to the least distance and its first start, over every item-sized window."""
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for i, x in items:
            x = (x or "").encode().lower().split()
            if len(x) >= 5:
                own = min(((distance(x, w[s : s + len(x)]), s) for s in range(len(w) - len(x) + 1)), default=None)
                if own and own[0] <= int(0.2 * len(x)):
                    out[d, i] = own
    return out


def edited(rng, w, n, word):
    w = list(w)
    for _ in range(n):
        at = rng.randrange(len(w))
        what = rng.randrange(3)
        w[at : at + (what != 1)] = [] if what == 2 else [word()]
    return w


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    word = lambda: rng.choice(vocab)
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 50)))) for i in range(25)] + [(90, None), (91, ""), (92, "one two"), (None, "alpha beta gamma delta epsilon zeta")]
    docs = []
    for i in range(70):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            x = rng.choice(items[:25])[1].split()
            w += edited(rng, x, rng.randint(0, int(0.2 * len(x)) + 2), word) + [word() for _ in range(rng.randint(0, 60))]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[3][1].upper().replace("É", "é")), (103, "x y z " * 8000 + items[4][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as start", "3 as distance"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")


def test_recall_and_precision(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        want = brute(docs[:-1], items)
        got = {(r.doc_id, r.item_id): (r.distance, r.start) for r in D.leaks(*frames(spark, docs, items), ["doc_id"]).collect()}
        assert (103, 4) in got
        got = {k: v for k, v in got.items() if k[0] != 103}
        assert set(got) <= set(want)
        assert len(got) >= 0.95 * len(want) and len(want) > 20
        assert sum(got[k] == want[k] for k in got) >= 0.9 * len(got)
        exact = {k for k, v in want.items() if v[0] == 0}
        assert exact <= set(got)


def test_runs_skip_no_window():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(5, 40)
        x = [rng.randint(1, 400) for _ in range(n)]
        items = D.Items([(0, " ".join(map(str, x)))], samples=8)
        w = edited(rng, map(str, x), D.allowed(n), lambda: str(rng.randint(1, 400)))
        before = ["9999"] * 20
        text = [items.vocabulary.get(v.encode(), 0) for v in before + w + before]
        import numpy as np

        starts = items.starts(np.array(text))
        close = {s for s in range(len(text) - n + 1) if distance(items.items[0], text[s : s + n]) <= D.allowed(n)}
        assert close <= starts.get(n, set())


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        most = rng.randint(0, 6)
        assert D.edit_distance(a, b, most) == min(distance(a, b), most + 1)


def mixed(rng, x, size):
    """x edited at the largest distance, of its size."""
    y, left = list(x), D.allowed(len(x))
    while left > 0:
        if left > 1 and rng.random() < 0.4:
            del y[rng.randrange(len(y))]
            y.insert(rng.randrange(len(y) + 1), rng.randint(0, size))
            left -= 2
        else:
            y[rng.randrange(len(y))] = rng.randint(0, size)
            left -= 1
    return y


def test_recall_by_size():
    """The sampling step at the largest distance, on other edits than those it was calibrated with."""
    rng = random.Random(11)
    for n in (10, 50, 200):
        items = D.Items([(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i in range(60)])
        tried = [(k, mixed(rng, items.items[k], len(items.vocabulary))) for k in range(60) for _ in range(8)]
        met = items.met([y for _, y in tried])
        assert all(distance(items.items[k], y) <= D.allowed(n) for k, y in tried[:20])
        assert sum((i, k) in met for i, (k, _) in enumerate(tried)) >= 0.98 * len(tried), n


def test_classes_without_enough_recall_are_checked_whole():
    rng = random.Random(12)
    items = D.Items([(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for i in range(20)], recall=1.01)
    assert set(items.samples.values()) == {0}
    tried = [(k, mixed(rng, items.items[k], len(items.vocabulary))) for k in range(20)]
    met = items.met([y for _, y in tried])
    assert all((i, k) in met for i, (k, _) in enumerate(tried))


def test_an_item_of_2000_words(spark):
    import tracemalloc

    rng = random.Random(13)
    item = [f"w{rng.randrange(9000)}" for _ in range(2000)]
    leak = edited(rng, item, 150, lambda: "other")
    other = [f"v{rng.randrange(9000)}" for _ in range(5000)]
    items = D.Items([(0, " ".join(item))])
    windows = [[items.vocabulary.get(w.encode(), 0) for w in (leak + other)[s : s + 2000]] for s in range(300)]
    tracemalloc.start()
    assert any(k == 0 for _, k in items.met(windows))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    docs = [(1, " ".join(other + leak + other)), (2, " ".join(other))]
    got = D.leaks(*frames(spark, docs, [(0, " ".join(item))]), ["doc_id"]).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 0)] and got[0].distance <= 400


def test_blocks_and_empty(spark, monkeypatch):
    docs, items = corpus(1)
    key = lambda df: sorted(map(str, df.collect()))
    one = key(D.leaks(*frames(spark, docs, items), ["doc_id"]))
    monkeypatch.setattr(D, "BLOCK", 7)
    several = key(D.leaks(*frames(spark, docs, items), ["doc_id"]))
    assert len(several) >= 0.95 * len(one)
    assert D.leaks(*frames(spark, [], items), ["doc_id"]).count() == 0
    assert D.leaks(*frames(spark, docs, []), ["doc_id"]).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, " ".join(r.text.lower().split())) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, " ".join(r.text.lower().split())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    whole = {(i, k) for i, t in docs for k, x in items if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in D.op9_decontamination(spark, d).collect()}
    assert whole and whole <= got
