"""Every named query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from ledgerloom.oracles import ORACLES
from ledgerloom.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    assert differences(QUERIES[name](spark, sf), duck, ORACLES[name]) == []


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry_points_hold_every_query():
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert ORACLES.keys() <= entry_points.oracle_sql().keys() <= entry_points.queries().keys()


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 571
