"""The page parsers give back the table that their pages were written from."""

import os

import oracle
import pytest
from merchloom.plans import shops

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(shops.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    assert oracle.compare(shops.QUERIES[name](spark, SF_DIR), duck, shops.SQL[name]) is None
