import pandas as pd
import pytest

from quillon.operators import cascade, joins, semantic
from quillon.operators.cascade import CascadeConfig
from quillon.sources.judges import ScriptedJudge


def pool(spark, rows):
    """rows: (score, positive)."""
    texts = [f"text number {i:04d}" for i in range(len(rows))]
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(rows)), "body": texts}))
    scored = {t: s for t, (s, _) in zip(texts, rows)}
    said = {t: "Yes" if y else "No" for t, (_, y) in zip(texts, rows)}
    return df, scored, said


def run(spark, tmp_path, rows, config, most=10**9, batch=False):
    df, scored, said = pool(spark, rows)
    log = tmp_path / "calls"
    cheap = ScriptedJudge(said, scored)
    if batch:
        cheap.said = {t: "UNCERTAIN" if s == 0 else said[t] for t, s in scored.items()}
    expensive = ScriptedJudge(said, most=most, log=str(log))
    f = cascade.batch_cascade if batch else cascade.row_cascade
    out = f(df, "id", "body", "q", cheap, expensive, config)
    got = {r.id: r for r in out.decisions.collect()}
    calls = [int(x) for x in log.read_text().split()] if log.exists() else []
    assert len(got) == len(rows)
    return got, out, calls


SEPARABLE = [(-5.0 - i / 1000, False) for i in range(60)] + [(5.0 + i / 1000, True) for i in range(60)]


def test_separable_pool_pays_for_its_labels_only(spark, tmp_path):
    got, out, calls = run(spark, tmp_path, SEPARABLE, CascadeConfig(budget=40))
    assert out.band.certified and sum(calls) == out.metrics["expensive_rows"] < 120
    assert all(got[i].passed == y for i, (_, y) in enumerate(SEPARABLE))
    m = out.metrics
    assert m["candidates"] == 120 == m.get("label", 0) + m.get("accept", 0) + m.get("reject", 0) + m.get("escalated", 0)


def test_open_band_equals_the_expensive_judge(spark, tmp_path):
    rows = [(float(i % 7), i in (3, 17)) for i in range(40)]
    got, out, calls = run(spark, tmp_path, rows, CascadeConfig(budget=20))
    assert sum(calls) <= 40
    if not out.band.certified:
        assert {i for i, r in got.items() if r.passed} == {3, 17}


def test_failures_escalate_and_zero_budget_too(spark, tmp_path):
    rows = [(None, True), (float("nan"), False), (2.0, True), (2.0, False)]
    got, out, calls = run(spark, tmp_path, rows, CascadeConfig(budget=0))
    assert [got[i].passed for i in range(4)] == [True, False, True, False] and sum(calls) == 4
    assert got[0].route == "escalated_failure" == got[1].route and got[2].route == "escalated"


def test_equal_scores_route_alike(spark, tmp_path):
    rows = [(float(i // 10), i >= 20) for i in range(40)]
    got, out, _ = run(spark, tmp_path, rows, CascadeConfig(manual=1.0))
    routes = {}
    for i, (s, _) in enumerate(rows):
        routes.setdefault(s, set()).add(got[i].route)
    assert all(len(v) == 1 for v in routes.values())


def test_batches_are_halved(spark, tmp_path):
    rows = [(0.0, i % 4 == 0) for i in range(40)]
    got, out, calls = run(spark, tmp_path, rows, CascadeConfig(budget=0), most=8, batch=True)
    assert sum(r.passed for r in got.values()) == 10 and not any(r.undecided for r in got.values())
    assert max(calls) == 32 and out.metrics["expensive_calls"] == len(calls) and out.metrics["cheap_calls"] == 5


def test_config_is_checked():
    for bad in ({"target": 0}, {"alpha": 1}, {"strata": 1}, {"budget": -1}, {"manual": -1}, {"cheap_batch": 0}, {"verify_batch": 8}):
        with pytest.raises(ValueError):
            CascadeConfig(**bad)


def test_seeded_samples(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "id long, score double")
    cuts = cascade.edges(cascade.histogram(df), 4)
    assert cuts == [9.0, 19.0, 29.0]
    draw = lambda s: {r.id for r in cascade.sample(df, cuts, [10] * 4, 8, s).collect()}
    assert draw("a") == draw("a") != draw("b") and len(draw("a")) == 8
    assert draw(None) == {0, 9, 10, 19, 20, 29, 30, 39}


def test_texts_are_asked_once(spark, tmp_path):
    log = tmp_path / "calls"
    judge = ScriptedJudge({"a long text here": "Yes"}, log=str(log))
    df = spark.createDataFrame([(1, "a long text here"), (2, "a long text here"), (3, "short"), (4, None)], "id long, t string")
    assert {r.id: r.a for r in semantic.judged(df, "t", "q", judge, "a").collect()} == {1: "Yes", 2: "Yes", 3: "No", 4: "No"}
    assert log.read_text().split() == ["1"]


def test_semantic_joins(spark, tmp_path):
    e = spark.createDataFrame([(i, f"e{i}") for i in range(30)], "id long, name string")
    t = spark.createDataFrame([(i % 35, f"text {i} of it") for i in range(70)], "id long, body string")
    judge = ScriptedJudge({f"text {i} of it": "Yes" for i in range(0, 70, 3)})
    want = sorted((i % 35, f"text {i} of it") for i in range(0, 70, 3) if i % 35 < 30)
    for out in (joins.single_pass_join(e, t, "id", "body", "q", judge), joins.block_join(e, t, "id", "body", "q", judge, 7, 11), joins.adaptive_join(e, t, "id", "body", "q", judge)):
        assert sorted((r.id, r.body) for r in out.rows.collect()) == want
    strict = ScriptedJudge(judge.said, most=4)
    lost = joins.single_pass_join(e, t, "id", "body", "q", strict)
    assert lost.rows.count() < len(want) and not lost.calls.where("overflow").isEmpty()
    assert joins.single_pass_join(e, t, "id", "body", "q", strict, retry=True).rows.count() == len(want)


def test_adaptive_rounds_share_one_order(spark, monkeypatch):
    """Rounds of other block sizes don't sort and join the texts again."""
    sorts, asked, order, ask = [], [], joins.with_ordinal, joins.asked
    monkeypatch.setattr(joins, "with_ordinal", lambda *a, **b: sorts.append(a) or order(*a, **b))
    monkeypatch.setattr(joins, "asked", lambda *a: asked.append(a) or ask(*a))
    e = spark.createDataFrame([(i, f"e{i}") for i in range(30)], "id long, name string")
    t = spark.createDataFrame([(i % 35, f"text {i} of it") for i in range(70)], "id long, body string")
    judge = ScriptedJudge({f"text {i} of it": "Yes" for i in range(0, 70, 3)}, most=4)
    out = joins.adaptive_join(e, t, "id", "body", "q", judge, budget=10**4, factor=64.0)
    assert sorted((r.id, r.body) for r in out.rows.collect()) == sorted((i % 35, f"text {i} of it") for i in range(0, 70, 3) if i % 35 < 30)
    assert out.calls.where("overflow").isEmpty() and len(asked) > 1 and len(sorts) == 2


def test_small_calls_reach_python_together(spark, monkeypatch):
    """Calls of one text are judged one by one, in a few groups."""
    stored, store = {}, joins.store
    monkeypatch.setattr(joins, "store", lambda df, name: stored.update({name: df}) or store(df, name))
    monkeypatch.setattr(joins, "ROWS", 100)
    e = spark.range(300).selectExpr("id", "'x' AS name")
    t = spark.range(350).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a b c d e f' ELSE 'yes' END AS body")
    out = joins.block_join(e, t, "id", "body", "q", ScriptedJudge({"a b c d e f": "Yes", "yes": "Yes"}), 10**9, 1, 69)
    assert sorted(r.id for r in out.rows.collect()) == [i for i in range(300) if i % 3]
    calls = out.calls.collect()
    assert len(calls) == 300 and all(r.rows == 1 and r.overflow == (r.block2 % 3 == 0) for r in calls)
    plan = stored["joined"]._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [__deal" in plan and "pmod" in plan and ", 4)" in plan


def test_packing():
    assert joins.pack([10, 10, 10], 100, 2) == [0, 0, 1]
    assert joins.pack([500, 10], 100, 25) == [0, 1]
    assert joins.pack([30, 30, 30], 100, 25, wanted=10) == [0, 0, 1]
    assert joins.completion_cap(1, 1000) == 48 and joins.completion_cap(20, 1000) == 336 and joins.completion_cap(90, 1000) == 512
    assert joins.optimal_block(10, 10, 8, 0, 1000, 0.0) == (50, 50)


def test_fitted_prefilter_and_seed(spark):
    from quillon.sources.judges import LexicalJudge

    judge = LexicalJudge({"q": ["x"]})
    rows = [(i, "x" * (5 if i % 2 else 0) + " text", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string, ordinal int")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(0, 400)], "id long, passed boolean")
    kept = {r.id for r in cascade.fitted_prefilter(df, "id", "t", "q", judge, labels).collect()}
    assert kept == {i for i in range(400) if i % 2}
    assert cascade.fitted_prefilter(df, "id", "t", "q", judge, labels.where("id < 3")).count() == 400
    assert cascade.compose_seed(None, "q", "m", 1) is None and cascade.compose_seed("7", "q", "m", 1) == "7:q/m:1"


def test_profile_equals_the_plain_fit(spark):
    import random

    from quillon.functions import beta

    rng = random.Random(1)
    rows = [(q, round(rng.gauss(2 * y, 1), digits), int(y)) for q, n, digits in (("a", 1500, 3), ("b", 300, 1), ("c", 40, 2)) for y in (rng.random() < 0.4 for _ in range(n))] + [("d", 1.0, 1)]
    got = {r.question: (r.accept, r.reject, r.n) for r in cascade.profile(spark.createDataFrame(rows, "question string, score double, label int")).collect()}
    for q in "abcd":
        own = [x for x in rows if x[0] == q]
        assert got[q] == (*beta.fit_thresholds([x[1] for x in own], [x[2] for x in own]), len(own))


def test_excerpts_equal_the_plain_ones(spark):
    import random

    from pyspark.sql import functions as F

    from quillon.functions import text

    rng = random.Random(1)
    texts = ["x" * 400, None, ""] + [" ".join("".join(rng.choice("abhandq") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for width in (60, 300):
        for patterns in (["ha+nd", "q"], ["zzzz"], []):
            for r in df.select("i", text.excerpt_column(F.col("t"), patterns, width).alias("e")).collect():
                assert r.e == text.excerpt(texts[r.i], patterns, width)
