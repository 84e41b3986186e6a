"""Queries of this folder that have SQL give the same rows in DuckDB."""

import pytest
from compare import connect, differences

from farebox.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE_SQL[name]) == []


def test_numbers_are_all_there():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
