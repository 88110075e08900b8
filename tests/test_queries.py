"""Every query of the core against its SQL in DuckDB."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = {n: (q, m.ORACLE.get(n)) for m in entry._modules() if ".llm." not in m.__name__ for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in OWN.items() if sql])
def test_same_rows_as_sql(spark, con, name):
    query, sql = OWN[name]
    assert differences(query(spark, SF), sql, con) == ""


@pytest.mark.parametrize("name", [n for n, (_, sql) in OWN.items() if not sql])
def test_runs(spark, name):
    assert OWN[name][0](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
