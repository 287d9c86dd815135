"""The registered queries: SQL where there is one, and what all of them hold to."""

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import comparable, oracle_connection, run_oracle
from newsweave.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def connection(tables):
    return oracle_connection(tables)


def test_registered():
    assert QUERIES.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert "pipeline" in queries()


@pytest.mark.parametrize("name", ORACLE)
def test_equals_sql(spark, connection, tables, name):
    frame = queries()[name](spark, tables)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    columns, rows = run_oracle(connection, ORACLE[name])
    assert sorted(columns) == sorted(frame.columns)
    actual = comparable([tuple(row) for row in frame.collect()], frame.columns)
    assert actual == comparable(rows, columns)
    assert actual


@pytest.mark.parametrize("name", ["op1_secret_ledger", "op2_sentence_licences", "op6_source_mix"])
def test_native(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
