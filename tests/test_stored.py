import os

from pyspark.sql import functions as F

from quillon.sources import stored


def files(spark):
    at = os.path.join(stored.shared_dir(spark).removeprefix("file:"), "quillon")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_a_scope_leaves_nothing(spark):
    before = files(spark)
    with stored.scope(spark):
        df = spark.range(10)
        assert stored.store(df, "a").count() == 10
        with stored.scope(spark):
            stored.with_ordinal(df, "id").collect()
        assert len(files(spark) - before) == 1
        df.write.mode("overwrite").saveAsTable("quillon_scoped")
        stored.owned_table(spark, "quillon_scoped")
    assert files(spark) == before and not spark.catalog.tableExists("quillon_scoped")


def test_prefixed(spark):
    rows = [(i % 7, i, i % 5 if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    got = stored.prefixed(df, ["g", "k"], {"v": "before"}).orderBy("g", "k").collect()
    most = stored.prefixed(df, ["k"], {"v": "top"}, "max").orderBy("k").collect()
    total, top = 0, None
    for r in got:
        assert r.before == total
        total += r.v or 0
    for r in most:
        assert r.top == top
        top = r.v if top is None else max(top, r.v or 0)
    assert stored.prefixed(df.where(F.lit(False)), ["k"], {"v": "b"}).count() == 0
