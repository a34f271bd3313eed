"""Every registered query runs, and equals DuckDB on the smallest tables where SQL can say it."""

from __future__ import annotations

import os

import pytest
from check_queries import compare, connect

from txnlens.plans import all_queries

FOLDER = os.environ.get("TXNLENS_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_contract():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE:
        assert compare(ours, duck.execute(ORACLE[name]).df()) == ""
    else:
        assert len(ours) > 0
