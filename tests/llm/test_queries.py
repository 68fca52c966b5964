"""The queries beside their SQL, and the rest for shape."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import connect, differences

from setlore.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p1_found": ["tag_a", "tag_b"], "p3_found": ["artist_a", "artist_b"], "p4_found": ["group_id", "field", "id"], "p5_found": ["id", "field", "pos", "entry"],
    "p6_found": ["id", "field"], "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "seg", "lang"],
}


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
    rows = df.count()
    assert rows > 0 and df.columns == COLUMNS.get(name, df.columns)
    assert name == "p8_ids" or df.distinct().count() == rows
