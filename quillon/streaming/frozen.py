"""A cascade with a band that was fitted before: stateless, so it runs on streams as on tables (an extension of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.beta import Band
from quillon.operators.cascade import route
from quillon.sources.judges import Judge


def frozen(df: DataFrame, text: str, question: str, cheap: Judge, expensive: Judge, band: Band) -> DataFrame:
    """df with score, route and passed. Both judges must be expressible as columns."""
    out = df.withColumn("score", cheap.score_column(F.col(text), question))
    out = out.withColumn("route", route(F.col("score"), F.lit(False), band.accept, band.reject))
    said = expensive.answer_column(F.col(text), question) == "Yes"
    return out.withColumn("passed", F.when(F.col("route") == "accept", True).when(F.col("route") == "reject", False).otherwise(said))
