"""Every core query against its SQL at the smallest scale."""

import pytest

from mendral.plans import file_queries, more_queries, queries, source_queries
from mendral.plans.adapters import Views
from tests.oracle import assert_same, connection

ALL = file_queries.QUERIES | more_queries.QUERIES | source_queries.QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, con, name):
    assert_same(ALL[name](Views(spark, sf)), queries.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    assert ALL[name](Views(spark, sf)).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
