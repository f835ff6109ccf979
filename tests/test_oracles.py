"""Every registered query against its SQL twin, over the smallest tables."""

import pytest

import __spark_entry__ as entry
import check
from docmill.workload import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(small):
    return check.database(small)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, con, name):
    ok, note = check.compare(spark, con, small, name)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
