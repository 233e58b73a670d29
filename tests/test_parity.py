"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from parity import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result, _, types = compare(spark, con, name, QUERIES, ORACLES, SF)
    assert result.startswith(("ok", "ROWS")), result
    assert types is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page", "block_id", "match_id", "coverage", "iou", "position", "method"]
    assert df.limit(1).count() == 1


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
