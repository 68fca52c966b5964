"""Every core query beside its SQL statement, and those without one for their shape."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import connect, differences

from setlore.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    mine, theirs = differences(QUERIES[name](spark, SF), con, ORACLES[name])
    assert not mine and not theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.entry(spark).columns) == {"tag_a", "tag_b", "n", "lift"}
