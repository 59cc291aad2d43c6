"""Connected components of an edge table, by alternating star contraction; no node's neighbours are gathered in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import at_keys, settle

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node that an edge a, b (long) names: root is the smallest node reachable.

    Each round points the larger neighbours of every node to its smallest one, then does so for the smaller ones; the
    number of rounds grows with the logarithm of the number of nodes. Null ends, loops and repeated edges do no harm.
    """
    e = settle(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        if e.isEmpty():
            break
        both = e.union(e.select("b", "a"))  # of a, b: b is a neighbour of a
        # n: the larger neighbours, of which one node can have a large part of all
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("n"))
        large = at_keys(both.where("b > a"), settle(least.where("n > 0"), "least"), "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("n"), F.col("a").alias("s"))  # s < n
        least = down.groupBy("n").agg(F.min("s").alias("m"))
        # every smaller neighbour of n, and n itself, now hang on the smallest
        small = down.join(least, "n").select(F.col("m").alias("a"), F.col("s").alias("b")).where("a < b").union(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()
        new = settle(small, "edges")
        # stars: no node is both a root and a leaf, and no leaf has two roots
        if new.groupBy("b").count().where("count > 1").isEmpty() and new.select("a").distinct().join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
