"""Every registered query against its SQL oracle on the smallest tables.

QUERIES="name name" takes some of them only.
"""

import os

import pytest

import check
from voxelmill.catalog import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
CHOSEN = os.environ.get("QUERIES", "").split() or sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, con, name):
    ok, note = check.compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
