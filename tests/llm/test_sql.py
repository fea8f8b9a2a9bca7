"""Queries of the package that have SQL, against it."""

import pytest

from compare import connect, differences
from ledgerloom.llm.entries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == []
