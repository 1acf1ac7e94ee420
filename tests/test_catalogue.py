"""Every registered query of the engine: against its SQL where it has one, else that it runs."""

import pytest

from tests.compare import duck, same
from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(catalogue.QUERIES[name](spark, sf), con, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() >= 0


def test_entry_points_hold_the_catalogue():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
