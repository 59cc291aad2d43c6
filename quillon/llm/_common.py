"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import let  # noqa: F401
from quillon.sources.stored import new_path, owned_table, passing, scope, store  # noqa: F401

#: A word: a run without the six ASCII white-space characters (also what bytes.split() yields).
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no rerun.

    The shuffle files behind df are let go, as nothing refers to them any more. The table goes with the scope that is open.
    """
    return store(df, name)


def release(spark: SparkSession) -> None:
    """Frees shuffle files of frames that went out of scope (Spark's cleaner follows the JVM's collector)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Keys of more rows than this, and than one in HOT_KEYS of all, are joined by a broadcast of HOT_KEYS rows at most.
HOT_ROWS, HOT_KEYS = 256, 20_000


def at_keys(rows: DataFrame, by_key: DataFrame, key: str = "band", n: str = "n") -> DataFrame:
    """rows joined to by_key (key, which is unique, and n, the rows that have it).

    Keys with many rows meet theirs by a broadcast, so none of them goes to one task. There are fewer than HOT_KEYS of
    these, as each has more than one in HOT_KEYS of all rows; the others are shuffled.
    """
    total = by_key.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(by_key.where(F.col(n) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(by_key.where(F.col(n) <= most), key)
    return rows.join(hot, key).unionByName(cold)
