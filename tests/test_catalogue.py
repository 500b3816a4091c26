"""Every catalogue query with SQL agrees with DuckDB on the smallest tables, in values and types."""

import os

import oracle
import pytest
from merchloom.plans import catalogue, oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_agrees_with_sql(spark, duck, name):
    assert oracle.compare(catalogue.QUERIES[name](spark, SF_DIR), duck, oracles.SQL[name]) is None


def test_every_query_is_registered():
    assert set(oracles.SQL) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(oracles.SQL) == {"dup_clusters", "merge_samples", "reconcile_report"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
