"""Every named query against its SQL counterpart on the driver tables."""

import pytest
from compare import difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert difference(spark, SF_DIR, name) is None


def test_every_query_has_sql():
    assert set(entry.CORE) <= set(entry.oracle_sql())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"status", "count"}
