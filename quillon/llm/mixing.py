"""Mixing sources to target weights with hash-threshold histograms, by DataFrame functions only.

Each text has a 60-bit hash that depends on its doc_id and text alone. Words are summed by source and by the next 12 bits
of the hash; a running sum over those 4,096 buckets finds the bucket in which a source's budget ends. Only texts of that
bucket are summed again, by the next 12 bits, until a bucket holds one hash. Texts whose hash lies below the threshold are
in the mix; nothing is sorted but each source's 4,096 sums. A larger budget gives a higher threshold, so the parts below
thresholds are nested. What then misses to the target is less than one text; the text left out whose size is nearest to
that gap closes it, if it brings the source nearer to its target.

A target of one to two times the source's size takes each text once and the rest of the target by threshold; two is the
most. Texts are never cut.

Defined results: a null text has size 0; a null source is a source of its own, after the others; rows with equal doc_id
and text share a hash, so all of them are taken or none; a source of size 0 has target 0; an empty table has an empty mix;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import cycle, islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import WORD, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 12, 5


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size and hash (60 bits, not negative) of each row; the only pass over the texts."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.coalesce(F.col("text"), F.lit(""))), 64 - BITS * LEVELS)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), h.alias("hash"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: budgets by weight, none above most times its source's size.

    sizes: source, source_size. Sources are ranked by code point, null last, and weigh weights in turn. The excess of
    sources at their cap goes to the others by weight. With sources in the order in which they reach their cap, the level
    (target by weight) of each is what all the earlier ones leave; from the first that is below its cap, all are.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    x = sizes.select("source", "source_size", rank.alias("rank"), weigh.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    x = x.withColumns({
        "left": F.sum(F.col("source_size").cast("double")).over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    below = F.col("cap") >= F.col("weight") * F.col("left") / F.col("rest")
    x = x.withColumn("level", F.max(F.when(below, F.col("left") / F.col("rest"))).over(everything))
    # levels rise along the order up to the first that is below its cap, and fall after it
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return x.select("source", "source_size", target.alias("target"))


def _bucket(h: Column, level: int) -> Column:
    return F.shiftright(h, BITS * (LEVELS - level))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, need (what the threshold leaves of the budget), edge (hashes below it are in) for each source.

    rows: source, size, hash. budgets: source, need.
    """
    state = budgets.select("source", "need", F.lit(0).cast("long").alias("edge"), F.lit(True).alias("open"))
    for level in range(1, LEVELS + 1):
        here = rows.join(state.where("open"), rows["source"].eqNullSafe(state["source"])).where(_bucket(F.col("hash"), level - 1) == _bucket(F.col("edge"), level - 1))
        sums = here.select(rows["source"], _bucket(F.col("hash"), level).alias("bucket"), "size", "hash").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("last"))
        order = Window.partitionBy("source").orderBy("bucket")
        ends = sums.withColumn("upto", F.sum("words").over(order)).join(state.select(F.col("source").alias("own"), "need"), F.col("source").eqNullSafe(F.col("own")))
        first = ends.where("upto > need").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("under"), "least", "last"), "bucket").alias("at"))
        moved = state.alias("s").join(first.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
        hit = F.col("f.at").isNotNull()
        one = hit & (F.col("f.at.least") == F.col("f.at.last"))
        top = F.lit(1 << (BITS * LEVELS)).cast("long")
        state = moved.select(
            F.col("s.source").alias("source"),
            (F.col("s.need") - F.when(hit, F.col("f.at.under")).otherwise(F.lit(0))).alias("need"),
            F.when(one, F.col("f.at.least")).when(hit, F.shiftleft(F.col("f.at.bucket"), BITS * (LEVELS - level))).when(F.col("s.open"), top).otherwise(F.col("s.edge")).alias("edge"),
            (hit & ~one).alias("open"),
        )
        state = settle(state, "mix-level")
        if level == LEVELS or state.where("open").isEmpty():
            return state.select("source", "need", "edge")
    raise AssertionError


def closing(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """source and extra: the hash left out whose words come nearest to need, if they bring the sum nearer to it."""
    out = rows.join(edges, rows["source"].eqNullSafe(edges["source"])).where("hash >= edge and need > 0")
    tied = out.groupBy(rows["source"], "hash").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    off = F.abs(F.col("need") - F.col("words"))
    return tied.where(off < F.col("need")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "hash"))["hash"].alias("extra"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs: taken is a multiple of size, most times at most."""
    rows = settle(sized(docs, seed), "mix-sizes")
    goal = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("full", full).withColumn("need", F.col("target") - F.col("full") * F.col("source_size"))
    edges = thresholds(rows, goal.select("source", "need"))
    more = closing(rows, edges)
    plan = goal.drop("need").alias("g").join(edges.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source"))).join(more.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")), "left")
    plan = settle(plan.select("g.source", "g.source_size", "g.target", "g.full", "e.edge", "m.extra"), "mix-plan")
    r, p = rows.alias("r"), plan.alias("p")
    again = (F.col("r.hash") < F.col("p.edge")) | (F.col("r.hash") == F.coalesce(F.col("p.extra"), F.lit(-1)))
    taken = F.col("r.size") * F.least(F.col("p.full") + again.cast("long"), F.lit(most))
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.doc_id", "r.size", "p.source_size", "p.target", taken.cast("long").alias("taken"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; a null text has size 0, null sources are one."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def weigh_in_turn(n: int, weights: tuple = WEIGHTS) -> list[int]:
    """The weights of n ranked sources."""
    return list(islice(cycle(weights), n))
