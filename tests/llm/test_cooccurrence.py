from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from setlore.llm import cooccurrence as op


def brute(baskets, least=1, share=0):
    sets = [{x for x in b if x is not None} for b in baskets if b]
    sets = [s for s in sets if s]
    n, one, two = len(sets), Counter(), Counter()
    for s in sets:
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return {(a, b): (c, one[a], one[b], n) for (a, b), c in two.items() if c >= least and (not share or share * c >= n)}


def rows(df):
    return {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in df.collect()}


def random_baskets(seed, items=40, n=120):
    rng = random.Random(seed)
    return [rng.choice([None, [], [None], [rng.choice([None, f"i{rng.randrange(items):03}"]) for _ in range(rng.randrange(12))]]) for _ in range(n)] + [["i001", "i001", "i002"]] * 7


@pytest.mark.parametrize("least, share", [(1, 0), (3, 0), (2, 20)])
def test_against_brute_force(spark, least, share):
    baskets = random_baskets(least)
    df = spark.createDataFrame([(b, "x", 1) for b in baskets], "tags array<string>, item_a string, n int")
    assert rows(op.cooccurrence(df, "tags", least, share)) == brute(baskets, least, share)


@pytest.mark.parametrize("least, share", [(1, 0), (3, 0), (2, 20)])
def test_beyond_the_dictionary(spark, monkeypatch, least, share):
    monkeypatch.setattr(op, "DICTIONARY", 3)
    monkeypatch.setattr(op, "AT_ONCE", 5)
    baskets = random_baskets(9)
    df = spark.createDataFrame([(b,) for b in baskets], "tags array<string>")
    assert rows(op.cooccurrence(df, "tags", least, share)) == brute(baskets, least, share)


def test_sixty_thousand_items(spark):
    rng = random.Random(2)
    baskets = [[f"i{int(60_000 * rng.random() ** 1.5):05}" for _ in range(12)] for _ in range(12_000)] + [[f"i{i:05}" for i in range(k, 60_000, 97)] for k in range(97)] * 2
    df = spark.createDataFrame([(b,) for b in baskets], "tags array<string>")
    assert len({x for b in baskets for x in b}) == 60_000 > op.DICTIONARY
    assert rows(op.cooccurrence(df, "tags", 3)) == brute(baskets, 3)


def test_blocks_and_one_long_basket(spark):
    baskets = [[f"i{i:04}" for i in range(600)], [f"i{i:04}" for i in range(0, 600, 7)], ["i0000", "i0599"]]
    df = spark.createDataFrame([(b,) for b in baskets], "tags array<string>")
    assert rows(op.cooccurrence(df, "tags", 2)) == brute(baskets, 2)


def test_gram_matches_a_dense_product():
    rng = np.random.default_rng(1)
    x = rng.random((50, 70)) < 0.1
    row, col = np.nonzero(x)
    want = x.astype(int).T @ x.astype(int)
    got = np.zeros((80, 80), int)
    for i, j, g in op.gram(row, col, 70, block=16):
        got[i * 16 : i * 16 + 16, j * 16 : j * 16 + 16] = g
        got[j * 16 : j * 16 + 16, i * 16 : i * 16 + 16] = g.T
    assert (got[:70, :70] == want).all()


def test_empty(spark):
    df = spark.createDataFrame([], "tags array<string>")
    assert op.cooccurrence(df, "tags", 5, 500).count() == 0
