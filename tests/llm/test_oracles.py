"""The training-data queries that SQL can express agree with DuckDB on the smallest tables."""

import oracle
import pytest
from merchloom.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_agrees_with_sql(spark, duck, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF_DIR), duck, oracles.SQL[name]) is None
