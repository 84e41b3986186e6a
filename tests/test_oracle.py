"""Every query with SQL gives the same rows, values and types in DuckDB."""

import pytest
from compare import connect, differences
from conftest import SF

from farebox.plans.oracle import ORACLE_SQL
from farebox.plans.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, SF), connection, ORACLE_SQL[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
