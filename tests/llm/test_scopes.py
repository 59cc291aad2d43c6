import os

import pytest

from quillon.llm import queries
from quillon.llm._common import scope
from quillon.sources.stored import shared_dir

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op6_simhash", "op10_secret_scans"])
def test_a_scope_leaves_nothing(spark, name):
    at = os.path.join(shared_dir(spark).removeprefix("file:"), "quillon")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    tables = {t.name for t in spark.catalog.listTables()}
    with scope(spark):
        assert queries.QUERIES[name](spark, D).count() > 0
    assert set(os.listdir(at)) == before
    assert {t.name for t in spark.catalog.listTables()} == tables
