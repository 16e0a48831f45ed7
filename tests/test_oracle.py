"""Every registered query against its SQL counterpart in DuckDB."""

import os
import re

import pytest

import __spark_entry__ as entry_module
from compare import connect, diff

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Python workers and joins without a key.
UNWANTED = re.compile("EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoop")
QUERIES = entry_module.catalog_queries()
ORACLE = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert diff(df, con, ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not UNWANTED.search(plan)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
