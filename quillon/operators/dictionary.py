"""Guidance for judges mined from texts: anchors by log-odds, exemplars by clustering, and lookup of a question's concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import excerpt_column, ngrams
from quillon.plans.predicates import pattern_mask
from quillon.sources.stored import store

# Words that say nothing of a concept.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def match_category(question: Column, categories: list[tuple[str, list[str]]]) -> Column:
    """The first category one of whose markers the question holds."""
    out = None
    for name, markers in categories:
        c = None
        for m in markers:
            hit = F.contains(F.lower(question), F.lit(m.lower()))
            c = hit if c is None else c | hit
        out = F.when(c, name) if out is None else out.when(c, name)
    return out


def concept_tokens(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(w), F.array(*map(F.lit, STOPWORDS)))


#: Tokens of concept phrases that may be broadcast; with more, the join shuffles.
BROADCAST_TOKENS = 200_000


def match_concepts(questions: DataFrame, concepts: DataFrame, least: float = 0.2) -> DataFrame:
    """id, concept, similarity: the concept that the question contains, else the nearest by Jaccard of tokens, if near enough.

    questions: id (a key), text. concepts: concept, phrase. Pairs meet by a shared token and are counted as ids; texts meet
    phrases only where the count says that the text can contain the phrase. Stop words can't be shared: a phrase of nothing
    else matches nothing.
    """
    c = concepts.select("concept", "phrase", concept_tokens(F.col("phrase")).alias("toks")).withColumn("m", F.size("toks"))
    c = store(c.select("concept", "phrase", "m", F.explode("toks").alias("tok")), "concepts")
    side = c.select("tok", "concept", "m")
    q = questions.select("id", F.explode(concept_tokens(F.col("text"))).alias("tok"))
    sizes = questions.select("id", F.size(concept_tokens(F.col("text"))).alias("n"))
    met = q.join(F.broadcast(side) if c.count() <= BROADCAST_TOKENS else side, "tok")
    near = store(met.groupBy("id", "concept").agg(F.count("*").alias("common"), F.first("m").alias("m")).join(sizes, "id"), "near")
    # a phrase inside a text shares all its tokens but the first and the last, which may be parts of longer ones
    maybe = near.where("common >= m - 2").select("id", "concept").join(c.select("concept", "phrase").distinct(), "concept")
    held = questions.join(maybe, "id").where(F.contains(F.lower("text"), F.lower("phrase"))).select("id", "concept").distinct().withColumn("inside", F.lit(True))
    near = near.join(held, ["id", "concept"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    sim = F.when(F.col("inside"), 1.0).otherwise(F.col("common") / (F.col("n") + F.col("m") - F.col("common")))
    ranked = near.select("id", "concept", sim.alias("similarity"), "inside").where(F.col("similarity") >= least)
    # of equal ones the first by name: a minimum over the negated rank needs no window over an id's rows
    key = F.struct((~F.col("inside")).alias("out"), (-F.col("similarity")).alias("far"), F.col("concept").alias("concept"))
    got = ranked.groupBy("id").agg(F.min(key).alias("b"))
    return got.select("id", "b.concept", (-F.col("b.far")).alias("similarity"))


def split_tag(key: Column, seed: str, share: int = 70) -> Column:
    """'dictionary' for share per cent of the keys, 'evaluation' for the others, by a seeded hash that any engine has (MD5)."""
    h = F.conv(F.left(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), F.lit(8)), 16, 10).cast("long")
    return F.when(h % 100 < share, "dictionary").otherwise("evaluation")


def proxy_labels(text: str, seeds: list[str], topic: list[str]) -> Column:
    """1 if a seed matches, 0 if only the topic does (a hard negative), null if neither."""
    return F.when(pattern_mask(text, seeds), 1).when(pattern_mask(text, topic), 0)


#: Texts of a task that counts terms: its map of terms then fits into memory, however large the tables' partitions are.
TEXTS = 1024


def document_frequency(df: DataFrame, text: str, label: str, most: int = 3) -> DataFrame:
    """term, pos, neg: texts of each label that hold the n-gram."""
    dealt = df.select(F.col(label).cast("int").alias("y"), F.col(text).alias("t")).repartition(df.count() // TEXTS + 1)
    t = dealt.select("y", F.explode(F.array_distinct(ngrams(F.col("t"), most))).alias("term"))
    return t.groupBy("term").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def anchors(df: DataFrame, text: str, label: str, most: int = 3, least_df: int = 2, top: int | None = 20, prior: float = 0.01) -> DataFrame:
    """term, pos, neg, z: terms that favour label 1 by log-odds with an informative prior, z above 0, largest first."""
    d = store(document_frequency(df, text, label, most).where(F.col("pos") + F.col("neg") >= least_df), "terms")
    n = d.agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0")).first()
    n1, n0 = float(n.n1 or 0), float(n.n0 or 0)
    a, total = prior * (F.col("pos") + F.col("neg")), prior * (n1 + n0)
    odds = lambda y, m: F.ln((y + a) / (m + total - y - a))
    delta = odds(F.col("pos"), n1) - odds(F.col("neg"), n0)
    z = delta / F.sqrt(1 / (F.col("pos") + a) + 1 / (F.col("neg") + a))
    out = d.withColumn("z", z).where("z > 0")
    return out.orderBy(F.col("z").desc(), "term").limit(top) if top else out


def _bucket(term: Column, size: int) -> Column:
    return (F.conv(F.left(F.md5(term), F.lit(8)), 16, 10).cast("long") % size).cast("int")


def hashed_embedding(df: DataFrame, key: str, text: str, size: int = 512) -> DataFrame:
    """key, vector: counts of hashed n-grams, of length 1."""
    t = df.select(key, F.explode(ngrams(F.col(text), 2)).alias("term")).select(key, _bucket(F.col("term"), size).alias("i"))
    c = t.groupBy(key, "i").agg(F.count("*").cast("double").alias("c"))
    g = c.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("len"), F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    return g.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("len")).alias("vector"))


def nearest_rows(df: DataFrame, key: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """cluster, key: for each centre the row nearest to it among the rows that have no nearer centre; ties by key.

    centres: a short list; it travels as a literal."""
    far = lambda c: F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    to = F.array(*(F.struct(far(c).alias("far"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)))
    near = df.select(key, F.array_min(to).alias("b")).select(key, "b.far", "b.cluster")
    return near.groupBy("cluster").agg(F.min(F.struct("far", key)).alias("b")).select("cluster", f"b.{key}")


def exemplars(df: DataFrame, key: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """cluster, key: the row nearest to each of k centres (k-means||, then Lloyd)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fitted = KMeans(k=k, seed=seed, maxIter=100).fit(df.select(array_to_vector(F.col(vector)).alias("features")))
    return nearest_rows(df, key, vector, [[float(x) for x in c] for c in fitted.clusterCenters()])


def excerpts(df: DataFrame, text: str, patterns: list[str], width: int = 300, out: str = "excerpt") -> DataFrame:
    return df.withColumn(out, excerpt_column(F.col(text), patterns, width))


def first_by_concept(df: DataFrame, order: list[str], each: int = 4) -> DataFrame:
    """The first rows of each (concept, label) by order."""
    n = F.row_number().over(Window.partitionBy("concept", "label").orderBy(*order))
    return df.withColumn("n", n).where(F.col("n") <= each).drop("n")


def guideline(entry: dict | None, required: bool = True) -> str:
    """Guidance text of a dictionary entry; a missing one is an error unless it is optional."""
    if entry is None:
        if required:
            raise KeyError("no dictionary entry for this question")
        return ""
    lines = [entry.get("template", "")]
    if entry.get("anchors"):
        lines.append("Signs: " + ", ".join(a["term"] for a in entry["anchors"]))
    for e in entry.get("examples", ()):
        lines.append("Example: " + (e["text"] if isinstance(e, dict) else str(e)))
    return "\n".join(x for x in lines if x)


def validate(dictionary: dict) -> list[str]:
    """What is wrong with a dictionary: entries need a template, terms with finite z, and a threshold that is null."""
    bad = []
    for name, e in dictionary.items():
        if not isinstance(e.get("template"), str):
            bad.append(f"{name}: no template")
        if e.get("threshold") is not None:
            bad.append(f"{name}: threshold must be null")
        for a in e.get("anchors", ()):
            if not a.get("term") or not isinstance(a.get("z"), int | float) or a["z"] != a["z"]:
                bad.append(f"{name}: bad anchor {a}")
    return bad
