"""Every registered query against its SQL counterpart on the given tables."""

import os

import pytest

from tests.oracle import compare, connect
from threadgrove.queries import all_queries, all_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = {"j7_frozen_probe", "l8_kmeans"}  # checked in test_evaluation.py


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    assert compare(spark, con, all_queries()[name], all_sql().get(name), SF_DIR) == ""


def test_only_iterative_queries_lack_sql():
    assert set(all_queries()) - set(all_sql()) == ROWS_ONLY
