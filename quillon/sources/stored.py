"""Results that cost money or time are written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Open scopes, the innermost last: what was written in each, as (kind, name).
_SCOPES: list[list[tuple[str, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes with the scope that is open."""
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(("path", path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def passing(spark: SparkSession, path: str) -> None:
    """Lets a written path go when the driver's JVM ends, whatever else happens."""
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)


def owned_table(spark: SparkSession, name: str) -> None:
    """Lets the scope that is open drop a table of the catalogue."""
    if _SCOPES:
        _SCOPES[-1].append(("table", name))


@contextmanager
def scope(spark: SparkSession):
    """What operators write to the shared folder or the catalogue inside it is gone at its end, so write results before that."""
    held: list[tuple[str, str]] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        _SCOPES.remove(held)
        for kind, name in reversed(held):
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            else:
                drop(spark, name)


def store(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: what is above it never runs twice, whatever fails later."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(schema).parquet(path)


def with_ordinal(df: DataFrame, *order, name: str = "ordinal") -> DataFrame:
    """df with the rank of each row (from 1) in the given total order, without gathering the rows in one task.

    A range-partitioned sort is written with each row's number in its partition; partitions' sizes give the offsets.
    """
    sorted_ = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__mono": F.monotonically_increasing_id()})
    kept = store(sorted_, "ordered")
    sizes = kept.groupBy("__part").count().orderBy("__part").collect()  # a row for each partition
    upto, offsets = 0, []
    for r in sizes:
        offsets.append((r["__part"], upto))
        upto += r["count"]
    by = df.sparkSession.createDataFrame(offsets, "__p int, __offset long")
    out = kept.join(F.broadcast(by), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col("__offset") + F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__mono", "__p", "__offset")


def prefixed(df: DataFrame, order: list[str], values: dict[str, str], how: str = "sum") -> DataFrame:
    """df with, for each column of values, a new column (its value): the sum (or max) of it over all rows before by order.

    order must be unique. Rows are dealt by ranges of the order; a window runs within each range, and what the ranges
    before it add is one row for each range, so no task ever sees all rows. Before the first row a sum is 0, a max null.
    """
    f = {"sum": F.sum, "max": F.max}[how]
    ranged = store(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    lows = F.min(F.struct(*order)).alias("__low")
    parts = ranged.groupBy("__part").agg(lows, *(f(c).alias(f"__{i}") for i, c in enumerate(values))).orderBy("__low").collect()
    upto, offsets = [0 if how == "sum" else None] * len(values), []
    for r in parts:
        offsets.append((r["__part"], *upto))
        for i in range(len(values)):
            x = r[f"__{i}"]
            upto[i] = upto[i] if x is None else x if upto[i] is None else upto[i] + x if how == "sum" else max(upto[i], x)
    kinds = dict(ranged.groupBy().agg(*(f(c).alias(f"__{i}") for i, c in enumerate(values))).dtypes)
    by = df.sparkSession.createDataFrame(offsets, ", ".join(["__p int", *(f"__o{i} {kinds[f'__{i}']}" for i in range(len(values)))]))
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(by), F.col("__part") == F.col("__p"))
    plus = (lambda a, b: F.coalesce(a, F.lit(0)) + b) if how == "sum" else F.greatest
    made = {name: plus(f(c).over(before), F.col(f"__o{i}")) for i, (c, name) in enumerate(values.items())}
    return joined.withColumns(made).drop("__part", "__p", *(f"__o{i}" for i in range(len(values))))
