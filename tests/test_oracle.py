"""Every registered query against its SQL at the smallest scale; SQL-free ones must run."""

import pytest

from amtskompass.plans import ORACLES, QUERIES
from oracle_check import compare, connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
