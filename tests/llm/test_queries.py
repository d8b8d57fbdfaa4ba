"""The registered queries on the smallest test data, against DuckDB where there is a statement."""

import os

import pytest

from check import compare, connect
from listenlake.llm import checks

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF_DIR), SF_DIR, name, checks.QUERIES[name], checks.ORACLES.get(name))
    assert ok, note


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in checks.QUERIES) == list(range(1, 14))
