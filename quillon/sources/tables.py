"""Table sources and sinks."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import PROMPT, collapse, let, prompt_text, unescape
from quillon.plans.schema import EntityTextSchema, pick_column


def csv_typed(spark: SparkSession, path: str, schema: EntityTextSchema) -> DataFrame:
    """A CSV file as the query path sees it: no null ids, numbers that don't parse are 0, missing texts are ''."""
    return coerced(csv_strings(spark, path, keep_null=True), schema)


def coerced(df: DataFrame, schema: EntityTextSchema) -> DataFrame:
    df = df.dropna(subset=[schema.id_col])
    of = {c: F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0)) if c in schema.numeric_cols else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != schema.id_col}
    return df.withColumns(of)


def csv_strings(spark: SparkSession, path: str, keep_null: bool = False) -> DataFrame:
    """A CSV file with all columns as strings, missing ones ''."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df if keep_null else df.na.fill("")


def with_prompt(df: DataFrame, columns: list[str], text: str | None = None, limit: int = PROMPT) -> DataFrame:
    """df with text: the columns rendered for a prompt, the text column cleaned of breaks first."""
    return df.withColumn("text", prompt_text({c: collapse(F.col(c)) if c == text else F.col(c) for c in columns}, limit))


def year_slice(df: DataFrame, year_col: str, year: int, order: list[str], most: int | None = None) -> DataFrame:
    """Complete rows of one year, the first most of them in order."""
    df = df.where(F.col(year_col).try_cast("double") == year).dropna()
    return df.orderBy(*order).limit(most) if most is not None else df


def tsv_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A (gzip) TSV dump with \\N as null; columns only."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="\\N", quote="").select(*columns)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """csv, tsv, jsonl, json (array) or parquet, by suffix."""
    kind = os.path.splitext(path.removesuffix(".gz"))[1].lower()
    if kind == ".csv":
        return csv_strings(spark, path)
    if kind == ".tsv":
        return spark.read.csv(path, sep="\t", header=True, nullValue="\\N")
    if kind in (".jsonl", ".ndjson"):
        return spark.read.json(path)
    if kind == ".json":
        return spark.read.json(path, multiLine=True)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


# Fixed value: what html.unescape takes for an entity.
_ENTITY = r"\&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <\&#;]{1,32};?)"


def unescaped(text: Column) -> Column:
    """html.unescape of a text. Python gets a text's distinct entities only, so that its memory doesn't depend on the texts."""

    @F.pandas_udf("array<string>")
    def plain(marks: pd.Series) -> pd.Series:
        return marks.map(lambda found: None if found is None else [unescape(x) for x in found])

    pieces = F.regexp_extract_all(text, F.lit(_ENTITY + r"|[^\&]+|\&"), F.lit(0))
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)))
    return let(F.map_from_arrays(marks, plain(marks)), lambda of: F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(of, x), x)), ""))


def text_rows(df: DataFrame, entity_aliases=("entity_id", "tconst", "product_id", "id"), text_aliases=("text", "review", "review_text")) -> DataFrame:
    """text_id, entity_id, text: entities unescaped, tags out, each (entity, text) once; the id is a hash of both."""

    e, t = pick_column(df.columns, *entity_aliases), pick_column(df.columns, *text_aliases)
    # most texts have no entity
    raw = df.select(F.col(e).cast("string").alias("entity_id"), F.col(t).alias("raw"))
    escaped = F.coalesce(F.contains("raw", F.lit("&")), F.lit(False))
    raw = raw.where(~escaped).unionByName(raw.where(escaped).withColumn("raw", unescaped(F.col("raw"))))
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", " "), r"\s+", " "))
    rows = raw.select("entity_id", body.alias("text")).where("text != ''").dropDuplicates()
    return rows.select(F.left(F.sha2(F.concat("entity_id", F.lit("\0"), "text"), 256), F.lit(24)).alias("text_id"), "entity_id", "text")


def load_spec(path: str, defaults: dict | None = None, env: dict[str, str] | None = None) -> dict:
    """A JSON specification over defaults; environment variables named in env (key to variable) come last."""
    with open(path) as f:
        out = (defaults or {}) | json.load(f)
    for key, name in (env or {}).items():
        if name in os.environ:
            out[key] = type(out[key])(os.environ[name]) if key in out and out[key] is not None else os.environ[name]
    return out


def write_results(frames: list[DataFrame], path: str, id_col: str, kind: str = "csv") -> None:
    """The union of frames with all their columns; without frames, a header of id_col needs a frame with it."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    assert id_col in out.columns
    (out.write.option("header", True) if kind == "csv" else out.write).format(kind).mode("overwrite").save(path)


def write_metrics(metrics: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump({k: None if isinstance(v, float) and v in (float("inf"), float("-inf")) else v for k, v in metrics.items()}, f, indent=1, default=str)


def write_suite(pools: dict[str, DataFrame], path: str) -> None:
    """All pools as one table, partitioned by question."""
    out = None
    for name, df in sorted(pools.items()):
        df = df.withColumn("question", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out.write.partitionBy("question").mode("overwrite").parquet(path)


def write_decisions(pairs: DataFrame, decisions: DataFrame, path: str) -> None:
    """decisions, evidence (passed pairs) and found (distinct passed ids) from results that are already stored."""
    decisions.write.mode("overwrite").parquet(f"{path}/decisions")
    passed = pairs.join(decisions.where("passed").select(F.col("id").alias("candidate_id"), "route", "match_source"), "candidate_id")
    passed.write.mode("overwrite").parquet(f"{path}/evidence")
    passed.select(pairs.columns[0]).distinct().write.mode("overwrite").parquet(f"{path}/found")
