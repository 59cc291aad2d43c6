"""Each query with SQL beside it gives what DuckDB gives; the others run."""

import math
import os

import duckdb
import pytest

from quillon import catalog

D = os.environ.get("QUILLON_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    got = df.collect()
    if name not in catalog.ORACLES:
        return
    rel = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    want = rel.fetchall()
    assert rows(df.columns, got) == rows(columns, want)
