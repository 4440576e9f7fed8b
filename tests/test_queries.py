"""Every registered query against its SQL counterpart, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from guestlens.checks.oracles import ORACLES
from guestlens.checks.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return compare.connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["hotel_name", "compound_score"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, db, name):
    assert compare.differences(QUERIES[name](spark, sf), ORACLES[name], db) == []
