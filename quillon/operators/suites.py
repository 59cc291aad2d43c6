"""Benchmark pools: rows in fixed numbers from the four quadrants of a structured and a semantic condition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import EXCERPT

# Rows by (structured, semantic) of the two domains' pools.
MOVIES = {(True, True): 12, (True, False): 28, (False, True): 30, (False, False): 30}
PRODUCTS = {(True, True): 15, (True, False): 35, (False, True): 25, (False, False): 25}


def scaled(sizes: dict, factor: int) -> dict:
    return {k: v * factor for k, v in sizes.items()}


def sized(n: int, structured: float = 0.5, positive: float = 0.3) -> dict:
    """A pool of n: a share passes the structured condition, and of those a share the semantic one; the rest half each."""
    s = round(n * structured)
    p = round(s * positive)
    rest = n - s
    return {(True, True): p, (True, False): s - p, (False, True): rest // 2, (False, False): rest - rest // 2}


def pool(df: DataFrame, structured: Column, semantic: Column, order: list[str], sizes: dict = MOVIES, strict: bool = False) -> DataFrame:
    """The first rows of each quadrant by order, with structured_match, semantic_label, ground_truth and pool_rank."""
    marked = df.withColumns({"structured_match": F.coalesce(structured, F.lit(False)), "semantic_label": F.coalesce(semantic, F.lit(False))})
    rank = F.row_number().over(Window.partitionBy("structured_match", "semantic_label").orderBy(*order))
    want = reduce(lambda c, kv: c.when((F.col("structured_match") == kv[0][0]) & (F.col("semantic_label") == kv[0][1]), kv[1]), sizes.items(), F.when(F.lit(False), 0))
    out = marked.withColumn("pool_rank", rank).where(F.col("pool_rank") <= max(sizes.values())).where(F.col("pool_rank") <= want)
    out = out.withColumn("ground_truth", F.col("structured_match") & F.col("semantic_label"))
    if strict:
        got = {(r.structured_match, r.semantic_label): r["count"] for r in out.groupBy("structured_match", "semantic_label").count().collect()}
        short = {k: (got.get(k, 0), v) for k, v in sizes.items() if got.get(k, 0) < v}
        if short:
            raise ValueError(f"not enough rows: {short}")
    return out


def pools(df: DataFrame, key: str, questions: list[tuple[str, Column, Column]], order: list[str], sizes: dict = MOVIES) -> dict[str, DataFrame]:
    """A pool for each (name, structured, semantic); a row is in one pool at most. The question with fewest truths chooses first."""
    from quillon.sources.stored import store

    counts = df.agg(*(F.sum((F.coalesce(s, F.lit(False)) & F.coalesce(m, F.lit(False))).cast("int")).alias(n) for n, s, m in questions)).first()
    out, used = {}, None
    for name, s, m in sorted(questions, key=lambda q: (counts[q[0]] or 0, q[0])):
        left = df if used is None else df.join(used, key, "left_anti")
        out[name] = store(pool(left, s, m, order, sizes), "pool")
        own = out[name].select(key)
        used = own if used is None else used.union(own)
    return out


def annotations(pool_: DataFrame, text: str, evidence: Column | None = None) -> DataFrame:
    """pool_ with annotation_source, evidence_excerpt and annotation_rationale."""
    why = F.when(F.col("ground_truth"), "both conditions hold").when(F.col("structured_match"), "only the structured condition holds").when(F.col("semantic_label"), "only the text condition holds").otherwise("neither condition holds")
    return pool_.withColumns({"annotation_source": F.lit("pattern"), "evidence_excerpt": evidence if evidence is not None else F.substring(text, 1, EXCERPT), "annotation_rationale": why})


def invariants(pool_: DataFrame, key: str, rows: int, truths: int) -> list[str]:
    """What a pool breaks: its size, its number of truths, or a key that stands twice."""
    r = pool_.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.sum(F.col("ground_truth").cast("int")).alias("truths")).first()
    return [m for bad, m in ((r.n != rows, f"{r.n} rows, not {rows}"), (r.keys != r.n, "a key twice"), ((r.truths or 0) < truths, f"{r.truths} truths, fewer than {truths}")) if bad]


def joined_texts(df: DataFrame, key: str, text: str, order: list[str], limit: int = 4000) -> DataFrame:
    """key, text: an entity's texts in order, joined by an empty line, cut to limit."""
    got = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"])
    return df.groupBy(key).agg(F.substring(F.array_join(got, "\n\n"), 1, limit).alias(text))


def restore_corpus(reviews: DataFrame, basics: DataFrame, crew: DataFrame, names: DataFrame) -> DataFrame:
    """Reviews with their movie's facts and directors' names: left joins, so that every review stays."""
    from quillon.operators.joins import lookup_list

    wanted = reviews.select("tconst").distinct()
    b = basics.join(wanted, "tconst", "left_semi").dropDuplicates(["tconst"])
    c = crew.join(wanted, "tconst", "left_semi").where("directors is not null")
    d = lookup_list(c, "tconst", "directors", names, "nconst", "primaryName", "director")
    return reviews.join(b, "tconst", "left").join(d, "tconst", "left")


def union_tables(tables: list[DataFrame], key: str) -> DataFrame:
    """Each key's row of all tables; an error if two tables give a key different rows."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).distinct()
    bad = every.groupBy(key).count().where("count > 1")
    if not bad.isEmpty():
        raise ValueError(f"different rows for {[r[0] for r in bad.orderBy(key).limit(5).collect()]}")
    return every
