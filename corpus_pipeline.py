"""A corpus from documents: quality rules, near-dedup, decontamination, secret scans, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of docs; the last returns the mix. Columns
besides doc_id, text, lang, source and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, mixing, nearcopies, rules, secrets
from quillon.llm._common import settle, text_of
from quillon.sources.stored import drop, new_path, passing, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no quality rule rejects. A null text counts as empty and is rejected; ties and repeated rows agree."""
    return rules.keep(docs)


def _fresh(docs: DataFrame, name: str) -> str:
    """A name for a column that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame, key: str = "key") -> DataFrame:
    """docs with key, equal for rows with equal doc_id and text only (128 bits of the two)."""
    return docs.withColumn(key, F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(text_of(), 256))))


def _texts(docs: DataFrame) -> DataFrame:
    return _keyed(docs.select("doc_id", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id (null last), then the smallest key.

    Rows that agree in doc_id and text are one document; of them the least by all columns stays. Null and empty texts are
    copies of each other. Very long texts are compared whole.
    """
    placed = nearcopies.groups(_texts(docs), "key", ["doc_id"])
    placed = placed.select(F.col("group").alias("g"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("who"))
    key, stays, row = (_fresh(docs, n) for n in ("key", "stays", "row"))
    first = settle(placed.groupBy("g").agg(F.min("who").alias("who")).select(F.col("who.key").alias(stays)), "stage-first")
    kept = _keyed(docs, key).join(first, F.col(key) == F.col(stays), "left_semi")
    # the rows of a document lie together after the join; of repeated ones the least stays, whatever order they come in
    least = kept.groupBy(key).agg(F.min(F.struct(*(c for c in docs.columns if c != "text"), "text")).alias(row))
    return least.select(*(F.col(row)[c].alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that leak no item of the benchmark, of whole texts; null and empty ones leak nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key, bad = _fresh(docs, "key"), _fresh(docs, "bad")
    leaks = settle(decontam.leaks(_texts(docs), benchmark, ["key"]).select(F.col("key").alias(bad)).distinct(), "stage-leaks")
    return _keyed(docs, key).join(leaks, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced by a mark, and n_chars follows. Null and empty texts stay as they are."""
    key, having, spans = (_fresh(docs, n) for n in ("key", "having", "spans"))
    found = secrets.scan(_texts(docs), ["key"]).where(F.size("spans") > 0).select(F.col("key").alias(having), F.col("spans").alias(spans))
    joined = _keyed(docs, key).join(settle(found.dropDuplicates([having]), "stage-secrets"), F.col(key) == F.col(having), "left")
    none = F.col(having).isNull()
    text = F.when(none, F.col("text")).otherwise(secrets.redact(text_of(), F.col(spans)))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(none, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; a null text has size 0, a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("secrets", hide_secrets), ("mixing", mixture)]

#: SQL has neither the fingerprints' hash nor the edit distances; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn, from documents; each result is written and read again, and what a stage needed besides it goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        passing(spark, path)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
