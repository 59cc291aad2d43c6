import os

import duckdb
import pytest

from quillon.llm import queries

D = os.environ.get("QUILLON_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    rel = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(rel.fetchall(), key=str)
