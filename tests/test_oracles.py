"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

from checks.compare import compare, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_duckdb(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


def test_every_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES)
