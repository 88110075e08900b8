"""Every query of the subpackage against its SQL in DuckDB."""

import pytest
from compare import connect, differences

from strataweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLE[name], con) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
