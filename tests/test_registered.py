"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import comparable, oracle_connection, run_oracle
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, connection, name):
    frame = queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    actual = comparable([tuple(row) for row in frame.collect()], frame.columns)
    columns, rows = run_oracle(connection, oracle_sql()[name])
    assert sorted(columns) == sorted(frame.columns)
    assert actual == comparable(rows, columns)
    assert actual, "an empty result compares nothing"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()


def test_entry(spark):
    assert entry(spark).count() == 50
