from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setlore.llm import mixture as op


@given(st.lists(st.tuples(st.integers(1, 10**6), st.floats(0.01, 1), st.integers(1, 5)), min_size=1, max_size=6), st.one_of(st.none(), st.floats(1, 10**7)))
@settings(max_examples=200, deadline=None)
def test_plan_keeps_the_caps(rows, total):
    names = [str(i) for i in range(len(rows))]
    tokens, targets, caps = ({n: r[i] for n, r in zip(names, rows)} for i in range(3))
    weights, size, t = op.plan(tokens, targets, caps, total)
    assert math.isclose(sum(weights.values()), 1, rel_tol=1e-9) and 0 <= t <= 1
    assert all(weights[n] * size <= caps[n] * tokens[n] * (1 + 1e-6) for n in names)
    if total is None:
        assert t == 0 and all(math.isclose(weights[n], targets[n] / sum(targets.values())) for n in names)


def test_entropy(spark):
    rows = [(i, s, 10) for s, n in (("a", 700), ("b", 200), ("c", 100)) for i in range(n)]
    texts = spark.createDataFrame(rows, "doc_id long, source string, n int")
    targets = spark.createDataFrame([(s, 0.1, 4) for s in "abc"], "source string, target_share double, max_repeats int")
    for nats in (0.9, 0.5, 1.05):
        got = {r.source: r for r in op.shares(op.mix(texts, "doc_id", "source", "n", targets, nats=nats), targets).collect()}
        assert op.entropy({s: r.share for s, r in got.items()}) == pytest.approx(nats, abs=0.01)
        powers = [math.log(got[x].share / got[y].share) / math.log(p / q) for x, y, p, q in (("a", "b", 0.7, 0.2), ("b", "c", 0.2, 0.1))]
        assert powers[0] == pytest.approx(powers[1], abs=0.12) and all(r.most_copies <= 4 for r in got.values())


def test_a_total_above_the_room_is_reached_by_the_exponent(spark):
    texts, targets = tables(spark)
    tokens = {"big": sum(10 + i % 7 for i in range(3000)), "small": 1000}
    weights, size, t = op.plan(tokens, {"big": 0.75, "small": 0.25}, {"big": 1, "small": 3}, 30_000)
    assert 0 < t < 1 and size == 30_000
    got = {r.source: r for r in op.shares(op.mix(texts, "doc_id", "source", "n", targets, total=30_000), targets).collect()}
    assert got["small"].most_copies == 3 and got["small"].tokens == 3000
    assert got["big"].tokens == pytest.approx(weights["big"] * size, abs=17)


def test_many_sources(spark):
    texts = spark.range(12_000).selectExpr("id AS doc_id", "concat('s', id) AS source", "5 AS n")
    targets = texts.selectExpr("source", "1 / 12000D AS target_share", "2 AS max_repeats")
    assert op.mix(texts, "doc_id", "source", "n", targets).agg({"copies": "sum", "doc_id": "count"}).first()[:] == (24_000, 12_000)


def tables(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 20) for i in range(50)] + [(20_000, None, 5), (20_001, "other", 5), (20_002, "big", 0), (20_003, "big", None)]
    targets = spark.createDataFrame([("big", 0.75, 1), ("small", 0.25, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    return spark.createDataFrame(rows, "doc_id long, source string, n int"), targets


def test_shares_and_repeats(spark):
    texts, targets = tables(spark)
    mixed = op.mix(texts, "doc_id", "source", "n", targets).cache()
    got = {r.source: r for r in op.shares(mixed, targets).collect()}
    assert got["small"].most_copies == 3 and got["small"].tokens == 3000
    assert got["big"].tokens == pytest.approx(9000, abs=17) and got["big"].most_copies == 1
    assert got["big"].share == pytest.approx(0.75, abs=0.002) and got["absent"].texts == 0
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    assert not {20_000, 20_001, 20_002, 20_003} & {r.doc_id for r in mixed.collect()}


def test_given_total(spark):
    texts, targets = tables(spark)
    got = {r.source: r.tokens for r in op.shares(op.mix(texts, "doc_id", "source", "n", targets, total=1000), targets).collect()}
    assert got["big"] == pytest.approx(750, abs=17) and got["small"] == pytest.approx(250, abs=20)


def test_empty(spark):
    texts, targets = tables(spark)
    assert op.mix(texts.limit(0), "doc_id", "source", "n", targets).count() == 0
    assert op.shares(op.mix(texts.limit(0), "doc_id", "source", "n", targets), targets).count() == 3
