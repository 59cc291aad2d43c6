"""Quality, cost and comparison metrics over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import wilson
from quillon.sources.stored import prefixed

PRICE = 3.0  # of an accelerator-hour


def prf(found: DataFrame, truth: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1; a rate without cases is 0."""
    a = found.select(*by, key).distinct().withColumn("__f", F.lit(1))
    b = truth.select(*by, key).distinct().withColumn("__t", F.lit(1))
    n = a.join(b, [*by, key], "full").groupBy(*by).agg(
        F.count(F.when(F.col("__f").isNotNull() & F.col("__t").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("__t").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("__f").isNull(), 1)).alias("fn"),
    )
    rate = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    n = n.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def means(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means by group; a boolean's mean is its rate."""
    return df.groupBy(*by).agg(*(F.avg(F.col(m).cast("int") if dict(df.dtypes)[m] == "boolean" else m).alias(m) for m in metrics))


def two_level(df: DataFrame, group: str, unit: str, metrics: list[str]) -> DataFrame:
    """Mean over repetitions for each unit, then mean and sample deviation over units by group."""
    inner = means(df, [group, unit], metrics)
    return inner.groupBy(group).agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def costs(df: DataFrame, wall: str, calls: str, expensive: str = "expensive_seconds", price: float = PRICE) -> DataFrame:
    """cost, cost_per_call (0 without calls), expensive_cost (by wall time where the stage has none)."""
    rate = F.lit(price / 3600)
    return df.withColumns({"cost": F.col(wall) * rate, "cost_per_call": F.coalesce(F.try_divide(F.col(wall) * rate, F.col(calls)), F.lit(0.0)), "expensive_cost": F.coalesce(expensive, wall) * rate})


def residual(wall: Column, cheap: Column, expensive: Column) -> Column:
    return F.greatest(F.lit(0.0), wall - F.coalesce(cheap, F.lit(0.0)) - F.coalesce(expensive, F.lit(0.0)))


def pareto(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Rows that none beats: none with low no larger and high no smaller, one of them better.

    Rows are summed up by low; a running maximum of high over smaller lows then decides, so rows never meet in pairs.
    """
    best = df.groupBy(low).agg(F.max(high).alias("__top"))
    over = prefixed(best, [low], {"__top": "__before"}, "max")
    on = over.where(F.col("__before").isNull() | (F.col("__top") > F.col("__before"))).select(F.col(low).alias("__low"), "__top")
    return df.join(on, (F.col(low) == F.col("__low")) & (F.col(high) == F.col("__top"))).select(df.columns)


def crossover(df: DataFrame, n: str, method: str, base: str, other: str, value: str, quality: str | None = None, share: float = 0.85) -> DataFrame:
    """crossover: the least n at which other's value is below base's; with quality, only where it reaches share of base's."""
    cols = [n, value, *([quality] if quality else [])]
    b = df.where(F.col(method) == base).select(*(F.col(c).alias(f"b_{c}") for c in cols))
    o = df.where(F.col(method) == other).select(*(F.col(c).alias(f"o_{c}") for c in cols))
    j = o.join(b, F.col(f"o_{n}") == F.col(f"b_{n}")).where(F.col(f"o_{value}") < F.col(f"b_{value}"))
    if quality:
        j = j.where(F.col(f"o_{quality}") >= share * F.col(f"b_{quality}"))
    return j.agg(F.min(f"o_{n}").alias("crossover"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc by mean ranks of ties, from counts by score: no pair is formed and no task sees all scores."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    by = prefixed(by, [score], {"n": "before"})
    t = by.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return t.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def index_percentiles(df: DataFrame, by: str, value: str, shares=(0.5, 0.9)) -> DataFrame:
    """by, n, mean and, for each share, the value at index floor(share * (n - 1)) of the sorted values (null ones aside).

    Running counts come from a sort by (by, value) in ranges, so that a group of any size is spread over tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    ends = prefixed(counts, [by, value], {"c": "before"})
    total = ends.groupBy(by).agg(F.min("before").alias("first"), F.sum("c").alias("n"), F.try_divide(F.sum(F.col(value) * F.col("c")), F.sum("c")).alias("mean"))
    total = total.withColumnRenamed(by, "__by")
    placed = ends.join(total, F.col(by).eqNullSafe(F.col("__by"))).withColumn("upto", F.col("before") - F.col("first") + F.col("c"))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.lit(s) * (F.col("n") - 1)), F.col(value))).alias(f"p{int(s * 100)}") for s in shares]
    return placed.groupBy(by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *picks)


def routing_shares(df: DataFrame, group: str, route: str, routes: list[str]) -> DataFrame:
    """group and, for each route, its share of the group's rows in per cent."""
    p = df.groupBy(group).pivot(route, routes).count().na.fill(0)
    total = sum((F.col(r) for r in routes[1:]), F.col(routes[0]))
    return p.select(group, *(F.try_divide(100.0 * F.col(r), total).alias(r) for r in routes))


def completeness(df: DataFrame) -> DataFrame:
    """column, pct: the share of rows whose value is not null, in per cent; one pass."""
    got = df.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in df.columns))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (100 * F.col(c)).alias("pct")) for c in df.columns))).alias("x")).select("x.*")


def failure_rates(df: DataFrame, by: str, failed: str, ratio: str) -> DataFrame:
    """by, n, failures, rate, its Wilson bounds, and mean, deviation, least and largest ratio."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("int")).alias("failures"), F.avg(ratio).alias("ratio_mean"), F.stddev_samp(ratio).alias("ratio_std"), F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"))
    lo, hi = wilson(F.col("failures"), F.col("n"))
    return g.withColumns({"rate": F.col("failures") / F.col("n"), "wilson_low": lo, "wilson_high": hi})


def tradeoff(df: DataFrame, by: str, name: str, recall: str, seconds: str, calls: str) -> DataFrame:
    """by and the name with the best 0.6 recall + 0.2 speed + 0.2 thrift, each scaled to the group's largest."""
    w = Window.partitionBy(by)
    part = lambda c: 1 - F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0))
    s = df.withColumn("tradeoff", 0.6 * F.col(recall) + 0.2 * part(seconds) + 0.2 * part(calls))
    return s.groupBy(by).agg(F.max_by(name, F.struct(F.col("tradeoff"), F.col(name))).alias("best"), F.max("tradeoff").alias("tradeoff"))


def rank_marks(df: DataFrame, by: str, name: str, metric: str, lower: bool = False) -> DataFrame:
    """df with mark: best, second or empty by metric."""
    w = Window.partitionBy(by).orderBy(F.col(metric).asc() if lower else F.col(metric).desc(), name)
    n = F.row_number().over(w)
    return df.withColumn("mark", F.when(n == 1, "best").when(n == 2, "second").otherwise(""))


def changes(df: DataFrame, by: str, method: str, base: str, other: str, metrics: list[str]) -> DataFrame:
    """by and, for each metric, the change from base to other in per cent."""
    b, o = (df.where(F.col(method) == m).select(F.col(by), *(F.col(x).alias(f"{p}{x}") for x in metrics)) for m, p in ((base, "b_"), (other, "o_")))
    return o.join(b, by).select(by, *(F.try_divide(100.0 * (F.col(f"o_{m}") - F.col(f"b_{m}")), F.col(f"b_{m}")).alias(f"{m}_change") for m in metrics))


def complete_runs(df: DataFrame, by: list[str], unit: str, expected: int) -> DataFrame:
    """Groups of by that don't have expected different units."""
    return df.groupBy(*by).agg(F.countDistinct(unit).alias("units")).where(F.col("units") != expected)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1 to bins), n of the values from low to high."""
    b = F.least(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    return df.where(F.col(value).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ordered_by(df: DataFrame, column: str, order: list[str], *then) -> DataFrame:
    """df sorted by a category in a given order; other values come last."""
    rank = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == v, i).otherwise(rank)
    return df.orderBy(rank, *then)


def shuffled(df: DataFrame, key: str, seed: str, most: int | None = None) -> DataFrame:
    """df in a seeded order; with most, its first rows."""
    out = df.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)
    return out.limit(most) if most is not None else out
