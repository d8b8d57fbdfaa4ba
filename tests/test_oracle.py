"""Every registered query against its DuckDB statement, on the smallest test data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import entry, queries  # noqa: E402
from check import compare, connect  # noqa: E402
from listenlake.checks import suite  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(suite.QUERIES) == set(suite.ORACLES) and set(suite.QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["title", "artist", "total_ms", "play_count", "listening_time"]


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, suite.QUERIES[name], suite.ORACLES[name])
    assert ok, note
