"""Cheap-to-expensive cascades: a cheap score decides what a calibrated band certifies, an expensive judge the rest.

Every candidate gets one route: label (the expensive judge saw it in the calibration sample), escalated_failure (no cheap
score), accept, reject, or escalated. Scores, labels and expensive answers are stored as soon as they exist.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import beta
from quillon.functions.text import BATCH, SHORT
from quillon.operators.semantic import judged
from quillon.sources.judges import NO, UNCERTAIN, YES, Judge
from quillon.sources.stored import prefixed, store, with_ordinal


@dataclass(frozen=True)
class CascadeConfig:
    target: float = 0.8
    budget: int = 20
    alpha: float = 0.9
    strata: int = 4
    manual: float | None = None
    seed: str | None = None
    cheap_batch: int = 8
    verify_batch: int = 32
    disabled: tuple[str, ...] = ()
    text_limit: int | None = BATCH  # characters of a text that a batch call sees

    def __post_init__(self):
        ok = 0 < self.target <= 1 and 0 < self.alpha < 1 and self.strata >= 2 and self.budget >= 0 and (self.manual is None or self.manual >= 0) and self.cheap_batch >= 1 and self.verify_batch > self.cheap_batch
        if not ok:
            raise ValueError(f"not a valid cascade: {self}")


@dataclass
class CascadeResult:
    """decisions: one row for each candidate (id, score, route, passed). metrics: counts, calls and the band."""

    decisions: DataFrame
    band: beta.Band
    metrics: dict = field(default_factory=dict)


def histogram(scored: DataFrame) -> DataFrame:
    """score, n, upto: distinct scores with their counts and the running count, by ranges of the score."""
    by = scored.where("score is not null").groupBy("score").agg(F.count("*").alias("n"))
    return prefixed(by, ["score"], {"n": "upto"}).withColumn("upto", F.col("upto") + F.col("n"))


def edges(hist: DataFrame, strata: int) -> list[float]:
    """The strata's upper edges: one lookup in the histogram for each cut, so that no list of scores reaches the driver."""
    n, out, cum = hist.agg(F.max("upto")).first()[0] or 0, [], 0
    for h in range(1, strata):
        want = max(beta.half_even(h * n / strata), cum + 1)
        at = hist.where(F.col("upto") >= want).orderBy("upto").first()
        if at is None or at.upto >= n:
            break
        cum = at.upto
        out.append(at.score)
    return out


def stratum(score: Column, cuts: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [(score > F.lit(e)).cast("int") for e in cuts], F.lit(0))


def sample(scored: DataFrame, cuts: list[float], sizes: list[int], budget: int, seed: str | None = None) -> DataFrame:
    """id of the rows to label: by stratum, evenly spaced by (score, id), or with a seed uniform without replacement."""
    spark = scored.sparkSession
    rows = scored.where("score is not null").select("id", "score", stratum(F.col("score"), cuts).alias("stratum"))
    if budget >= sum(sizes):
        return rows.select("id")
    takes = beta.allocate(sizes, budget)
    if seed is not None:
        order = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        n = F.element_at(F.array(*map(F.lit, takes)), F.col("stratum") + 1)
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max([*takes, 1])).where(F.col("rank") <= n).select("id")
    wanted, before = [], 0
    for size, take in zip(sizes, takes):
        wanted += [before + r + 1 for r in beta.spaced(size, take)]
        before += size
    if not wanted:
        return rows.where("false").select("id")
    # budget ranks at most; a run of equal scores is spread over tasks, as the order goes on by id
    ranks = spark.createDataFrame([(w,) for w in wanted], "rank long")
    ranked = with_ordinal(rows.select("id", "score"), "score", "id")
    return ranked.join(F.broadcast(ranks), F.col("ordinal") == F.col("rank"), "left_semi").select("id")


def counts_by_stratum(scored: DataFrame, cuts: list[float], labels: DataFrame | None = None) -> tuple[list[int], list[int], list[int]]:
    """(sizes, labelled, positives); labels: id, passed (null if the judge did not say)."""
    k = len(cuts) + 1
    rows = scored.where("score is not null").withColumn("stratum", stratum(F.col("score"), cuts))
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("passed", "__y"), "id", "left")
        agg = [F.count("*").alias("n"), F.count("__y").alias("m"), F.sum(F.coalesce(F.col("__y").cast("int"), F.lit(0))).alias("y")]
    else:
        agg = [F.count("*").alias("n"), F.lit(0).alias("m"), F.lit(0).alias("y")]
    got = {r.stratum: r for r in rows.groupBy("stratum").agg(*agg).collect()}
    return tuple([getattr(got[i], c) if i in got else 0 for i in range(k)] for c in ("n", "m", "y"))


def route(score: Column, labelled: Column, accept: float, reject: float) -> Column:
    return F.when(labelled, "label").when(score.isNull(), "escalated_failure").when(score >= F.lit(accept), "accept").when(score <= F.lit(reject), "reject").otherwise("escalated")


def _cascade(candidates: DataFrame, scored: DataFrame, config: CascadeConfig, verify) -> CascadeResult:
    """candidates: id, text. scored: id, score (stored). verify(rows of id, text) gives id, passed (null: no decision), stored."""
    hist = store(histogram(scored), "histogram")
    band, labels, labelled_n = beta.Band(), None, 0
    if config.manual is not None:
        band = beta.Band(accept=config.manual, reject=-config.manual)
    else:
        cuts = edges(hist, config.strata)
        sizes, _, _ = counts_by_stratum(scored, cuts)
        if config.budget and sum(sizes):
            chosen = store(sample(scored, cuts, sizes, config.budget, config.seed), "sample")
            labels = verify(candidates.join(chosen, "id", "left_semi"))
            labelled_n = chosen.count()
            sizes, m, y = counts_by_stratum(scored, cuts, labels)
            if labelled_n < sum(sizes):
                band = beta.fit_band(cuts, sizes, m, y, config.target, config.alpha)
            else:
                band = beta.Band(sizes=sizes, labelled=m, positives=y)
    none = scored.sparkSession.createDataFrame([], scored.select("id").schema.add("passed", "boolean"))
    known = (labels if labels is not None else none).select(F.col("id").alias("__i"), F.col("passed").alias("__l"))
    routed = scored.join(known, F.col("id") == F.col("__i"), "left")
    routed = store(routed.select("id", "score", route(F.col("score"), F.col("__l").isNotNull(), band.accept, band.reject).alias("route"), F.col("__l").alias("label")), "routed")
    expensive = verify(candidates.join(routed.where("route like 'escalated%'"), "id", "left_semi"))
    e = expensive.select(F.col("id").alias("__e"), F.col("passed").alias("__p"))
    done = routed.join(e, F.col("id") == F.col("__e"), "left")
    passed = F.coalesce(F.when(F.col("route") == "label", F.col("label")).when(F.col("route") == "accept", True).when(F.col("route") == "reject", False).otherwise(F.col("__p")), F.lit(False))
    undecided = F.col("route").startswith("escalated") & F.col("__p").isNull()
    source = F.when(F.col("route") == "accept", "cheap_accept").when(passed, "expensive_accept")
    decisions = store(done.select("id", "score", "route", passed.alias("passed"), undecided.alias("undecided"), source.alias("match_source")), "decisions")
    by = {r.route: r["count"] for r in decisions.groupBy("route").count().collect()}
    metrics = {"candidates": sum(by.values()), **by, "labelled": labelled_n, "expensive_rows": labelled_n + sum(v for k, v in by.items() if k.startswith("escalated")), "accept_at": band.accept, "reject_at": band.reject}
    return CascadeResult(decisions, band, metrics)


def cheap_scores(rows: DataFrame, question: str, judge: Judge) -> DataFrame:
    """id, score of rows (id, text), stored; null if the judge failed or the score is no finite number."""
    native = judge.score_column(F.col("text"), question)
    if native is None:

        def call(batches):
            for b in batches:
                s = pd.Series(judge.scores(b["text"].tolist(), question), dtype="float64")
                yield pd.DataFrame({"id": b["id"], "score": s.where(s.abs() < math.inf)})

        rows = rows.select("id", "text").mapInPandas(call, rows.select("id").schema.add("score", "double"))
    else:
        rows = rows.select("id", native.alias("score"))
    return store(rows.select("id", F.when(~F.isnan("score"), F.col("score")).alias("score")), "scores")


def row_cascade(df: DataFrame, id_col: str, text_col: str, question: str, cheap: Judge, expensive: Judge, config: CascadeConfig = CascadeConfig(), more: list[str] = ()) -> CascadeResult:
    """One expensive call for each row that needs one. Texts under SHORT characters are rejected without any call.

    more: columns that the judges refer to. A question in config.disabled goes to the expensive judge alone.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < SHORT
    asked = rows.where(~short)

    def verify(x: DataFrame) -> DataFrame:
        said = judged(x, "text", question, expensive, "__a")
        return store(said.select("id", (F.lower("__a") == "yes").alias("passed")), "expensive")

    if question in config.disabled:
        scored = store(asked.select("id", F.lit(None).cast("double").alias("score")), "scores")
    else:
        native = cheap.score_column(F.col("text"), question)
        scored = store(asked.select("id", native.alias("score")), "scores") if native is not None else cheap_scores(asked, question, cheap)
    out = _cascade(asked, scored, config, verify)
    little = rows.where(short).select("id", F.lit(None).cast("double").alias("score"), F.lit("short").alias("route"), F.lit(False).alias("passed"), F.lit(False).alias("undecided"), F.lit(None).cast("string").alias("match_source"))
    out.decisions = out.decisions.unionByName(little)
    return out


# The score of each three-way label.
LABEL_SCORES = {YES: 2.0, NO: -2.0, UNCERTAIN: 0.0}


def batched(rows: DataFrame, size: int, order: str = "ordinal") -> DataFrame:
    """rows with batch: consecutive slices of size by order (from 1)."""
    return rows.withColumn("batch", F.floor((F.col(order) - 1) / size))


def label_batches(rows: DataFrame, question: str, judge: Judge, size: int, limit: int | None = BATCH) -> DataFrame:
    """id, score by three-way labels of batches (rows: id, text, ordinal); a batch that misses an id fails whole. Stored."""

    def call(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ordinal")
        got = judge.decide([(t or "")[:limit] for t in b["text"]], question)
        full = all(i in got for i in range(len(b)))
        return pd.DataFrame({"id": b["id"], "score": [LABEL_SCORES[got[i]] if full else None for i in range(len(b))]}).astype({"score": "float64"})

    return store(batched(rows, size).groupBy("batch").applyInPandas(call, rows.select("id").schema.add("score", "double")), "scores")


def bisect(texts: list[str], question: str, judge: Judge) -> tuple[list[bool | None], int]:
    """(decision of each text, calls): a batch without a yes or no for all is halved; a single failure stays None."""
    got, calls = judge.decide(texts, question), 1
    if all(got.get(i) in (YES, NO) for i in range(len(texts))):
        return [got[i] == YES for i in range(len(texts))], calls
    if len(texts) == 1:
        return [None], calls
    mid = len(texts) // 2
    (a, m), (b, n) = bisect(texts[:mid], question, judge), bisect(texts[mid:], question, judge)
    return a + b, calls + m + n


def verify_batches(rows: DataFrame, question: str, judge: Judge, size: int, limit: int | None = BATCH) -> DataFrame:
    """id, passed, calls of rows (id, text) in batches of size by id, halved when they fail. Stored."""

    def call(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ordinal")
        said, calls = bisect([(t or "")[:limit] for t in b["text"]], question, judge)
        return pd.DataFrame({"id": b["id"], "passed": pd.array(said, "boolean"), "calls": [calls] + [0] * (len(b) - 1)})

    ranked = with_ordinal(rows.select("id", "text"), "id")
    return store(batched(ranked, size).groupBy("batch").applyInPandas(call, rows.select("id").schema.add("passed", "boolean").add("calls", "long")), "verified")


def pairs(entities: DataFrame, texts: DataFrame, entity_id: str, text_id: str, text: str) -> DataFrame:
    """candidate_id, entity columns, text: the equi-join by id, numbered by text order, then entity id."""
    t = texts.select(F.col(text_id).alias("__tid"), F.col(text).alias("__text"), *([F.col("ordinal").alias("__o")] if "ordinal" in texts.columns else []))
    joined = entities.join(t, F.col(entity_id) == F.col("__tid"))
    order = (["__o"] if "__o" in joined.columns else []) + [entity_id, "__text"]
    out = with_ordinal(joined, *order, name="candidate_id")
    return out.drop("__o").withColumnsRenamed({"__tid": f"text_{text_id}", "__text": "text" if text not in entities.columns else f"text_{text}"})


def batch_cascade(df: DataFrame, id_col: str, text_col: str, question: str, cheap: Judge, expensive: Judge, config: CascadeConfig = CascadeConfig()) -> CascadeResult:
    """As row_cascade, with several rows in each call: three-way labels in small batches, verification in larger ones."""
    rows = with_ordinal(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    scored = label_batches(rows, question, cheap, config.cheap_batch, config.text_limit)
    calls = []

    def verify(x: DataFrame) -> DataFrame:
        v = verify_batches(x, question, expensive, config.verify_batch, config.text_limit)
        calls.append(v)
        return v.select("id", "passed")

    out = _cascade(rows.select("id", "text"), scored, config, verify)
    out.metrics["cheap_calls"] = -(-out.metrics["candidates"] // config.cheap_batch)
    out.metrics["expensive_calls"] = sum(v.agg(F.sum("calls")).first()[0] or 0 for v in calls)
    return out


def assemble(pairs_: DataFrame, decisions: DataFrame, entity: list[str], text_id: str, text: str) -> DataFrame:
    """The passed candidates with match_source, each (entity, text id, text) once: cheap accepts come first, then by id."""
    kept = pairs_.join(decisions.where("passed").select(F.col("id").alias("candidate_id"), "match_source"), "candidate_id")
    order = Window.partitionBy(*entity, text_id, text).orderBy((F.col("match_source") != "cheap_accept").cast("int"), "candidate_id")
    return kept.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def cascade_join(entities: DataFrame, texts: DataFrame, entity_id: str, text_id: str, text: str, question: str, cheap: Judge, expensive: Judge, config: CascadeConfig = CascadeConfig()) -> tuple[DataFrame, CascadeResult]:
    """(rows, result): entities joined to their texts where the cascade says yes."""
    p = store(pairs(entities, texts, entity_id, text_id, text), "pairs")
    body = "text" if "text" in p.columns else f"text_{text}"
    result = batch_cascade(p, "candidate_id", body, question, cheap, expensive, config)
    return assemble(p, result.decisions, [entity_id], f"text_{text_id}", body), result


def reject_prefilter(df: DataFrame, id_col: str, text_col: str, question: str, judge: Judge, threshold: float | None) -> DataFrame:
    """Ids that a reject-only prefilter keeps: the last score of an id (by ordinal) above threshold, or no score; all if None."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "ordinal")
    if threshold is None:
        return rows.select("id").distinct()
    scored = rows.withColumn("score", judge.score_column(F.col("text"), question))
    last = scored.groupBy("id").agg(F.max_by("score", "ordinal").alias("score"))
    return last.where(F.col("score").isNull() | (F.col("score") > threshold)).select("id")


def fitted_prefilter(df: DataFrame, id_col: str, text_col: str, question: str, judge: Judge, labels: DataFrame, recall: float = 0.9, alpha: float = 0.85) -> DataFrame:
    """reject_prefilter with the threshold that labels (id, passed) certify; without one, every id is kept."""
    rows = df.select(F.col(id_col).alias("id"), judge.score_column(F.col(text_col), question).alias("score"), "ordinal")
    last = rows.groupBy("id").agg(F.max_by("score", "ordinal").alias("score"))
    seen = last.join(labels.select("id", "passed"), "id").where("score is not null").select("score", F.col("passed").cast("int").alias("y")).collect()  # labels are a calibration sample
    cut = beta.reject_cut([r.score for r in seen], [r.y for r in seen], recall, alpha)
    return reject_prefilter(df, id_col, text_col, question, judge, cut if cut > -math.inf else None)


def compose_seed(base: str | None, question: str, method: str, repetition: int) -> str | None:
    """The calibration seed of one repetition, 'base:question/method:repetition'; none without a base."""
    return None if base is None else f"{base}:{question}/{method}:{repetition}"


def agreement(decisions: DataFrame) -> DataFrame:
    """agreement: share of labelled rows whose score has the sign of the label. decisions: score, label."""
    return decisions.where("label is not null and score is not null").agg(F.avg(((F.col("score") >= 0) == F.col("label")).cast("int")).alias("agreement"))


def profile(scored: DataFrame, accept_target: float = 0.9, reject_target: float = 0.9, alpha: float = 0.9) -> DataFrame:
    """question, accept, reject, n for each question of scored (question, score, label): as beta.fit_thresholds for each.

    Every distinct score is a row with the running counts of its question; the bounds are tested row by row, and the widest
    cuts that hold are an aggregate, so no question's rows meet in one task.
    """
    by = scored.where("score is not null and label is not null and not isnan(score)").groupBy("question", F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    ran = prefixed(by, ["question", "score"], {"n": "__n", "pos": "__pos"})
    total = ran.groupBy("question").agg(F.min("__n").alias("n0"), F.min("__pos").alias("pos0"), F.sum("n").alias("all"), F.sum("pos").alias("good"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = ran.join(total.withColumnRenamed("question", "__q"), F.col("question").eqNullSafe(F.col("__q")))
    below, pos = F.col("__n") - F.col("n0"), F.col("__pos") - F.col("pos0")  # before this score
    rows = rows.select("question", "score", "n", "pos", "all", "good", "lo", "hi", below.alias("before"), pos.alias("pos_before"))

    def held(batches):
        for b in batches:
            above, good = b["all"] - b["before"], b["good"] - b["pos_before"]
            upto, bad = b["before"] + b["n"], b["before"] + b["n"] - b["pos_before"] - b["pos"]
            accepts = [beta.reaches(int(g), int(a - g), accept_target, alpha) for g, a in zip(good, above)]
            rejects = [beta.reaches(int(x), int(u - x), reject_target, alpha) for x, u in zip(bad, upto)]
            yield b.assign(accepts=accepts, rejects=rejects)

    rows = store(rows.mapInPandas(held, rows.select("*").schema.add("accepts", "boolean").add("rejects", "boolean")), "profile")
    upto = F.col("before") + F.col("n")
    mids = [F.min(F.when(upto > F.floor(x), F.col("score"))) for x in ((F.col("all") - 1) / 2, F.col("all") / 2)]
    cut = rows.groupBy("question").agg(F.min(F.when(F.col("accepts"), F.col("score"))).alias("a"), F.max(F.when(F.col("rejects"), F.col("score"))).alias("r"), F.max("all").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), ((mids[0] + mids[1]) / 2).alias("mid"))
    # the next scores to either side, between which cuts on the grid decide the same rows
    other = rows.select(F.col("question").alias("__q"), F.col("score").alias("s"))
    sides = cut.join(other, F.col("question").eqNullSafe(F.col("__q"))).groupBy("question").agg(*(F.first(c).alias(c) for c in ("a", "r", "n", "lo", "hi", "mid")), F.max(F.when(F.col("s") < F.col("a"), F.col("s"))).alias("down"), F.min(F.when(F.col("s") > F.col("r"), F.col("s"))).alias("up"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(beta.GRID - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(beta.GRID - 1.0))
    least = F.coalesce(F.array_min(F.filter(grid, lambda g: (g > F.col("down")) & (g <= F.col("a")))), F.col("a"))
    most = F.coalesce(F.array_max(F.filter(grid, lambda g: (g < F.col("up")) & (g >= F.col("r")))), F.col("r"))
    accept = F.coalesce(F.when(F.col("down").isNull(), F.col("a")).otherwise(least), F.lit(math.inf))
    reject = F.coalesce(F.when(F.col("up").isNull(), F.col("r")).otherwise(most), F.lit(-math.inf))
    crossed = accept <= reject
    return sides.select("question", F.when(crossed, F.col("mid")).otherwise(accept).alias("accept"), F.when(crossed, F.col("mid")).otherwise(reject).alias("reject"), "n")


def simulate(spark, trials: int, rows: int = 200, positive: float = 0.3, shift: float = 2.0, config: CascadeConfig = CascadeConfig(budget=40)) -> DataFrame:
    """trial, certified, recall, decided of random pools: the fit's validity and power."""

    def run(batches):
        import random

        for b in batches:
            out = []
            for trial in b["id"]:
                rng = random.Random(int(trial) * 7919 + 13)
                pool = sorted((rng.gauss(shift if (y := rng.random() < positive) else 0.0, 1.0), y) for _ in range(rows))
                cuts = beta.stratum_edges([(s, 1) for s, _ in pool], config.strata)
                strata = [[] for _ in range(len(cuts) + 1)]
                for s, y in pool:
                    strata[beta.stratum_of(s, cuts)].append((s, y))
                takes = beta.allocate([len(x) for x in strata], config.budget)
                seen = [[x[i] for i in beta.spaced(len(x), t)] for x, t in zip(strata, takes)]
                band = beta.fit_band(cuts, [len(x) for x in strata], [len(x) for x in seen], [sum(y for _, y in x) for x in seen], config.target, config.alpha, 500)
                known = {p for x in seen for p in x}
                lost = sum(y for s, y in pool if s <= band.reject and (s, y) not in known)
                every = sum(y for _, y in pool)
                decided = sum((s <= band.reject or s >= band.accept) and (s, y) not in known for s, y in pool)
                out.append((int(trial), band.certified, 1 - lost / every if every else 1.0, decided))
            yield pd.DataFrame(out, columns=["trial", "certified", "recall", "decided"])

    return spark.range(trials).mapInPandas(run, "trial long, certified boolean, recall double, decided long")
