from __future__ import annotations

import random
from itertools import product

from pyspark.sql import functions as F

from setlore.llm.survivor import Bundle, branch_and_bound, survivors


def exhaustive(candidates, dependencies, allowed):
    names, nothing = sorted(candidates), 1 + sum(map(len, candidates.values()))
    best = None
    for choice in product(*[[*range(len(candidates[b])), None] for b in names]):
        chosen = {b: candidates[b][i] for b, i in zip(names, choice) if i is not None}
        if all(not (a in chosen and b in chosen) or (chosen[a][1].get(x), chosen[b][1].get(y)) in pairs for (a, x, b, y), pairs in zip(dependencies, allowed)):
            loss = sum(nothing if i is None else i for i in choice)
            best = loss if best is None else min(best, loss)
    return best


def test_branch_and_bound_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        candidates = {b: [(f"{b}{i}", {"x": rng.randrange(3), "y": rng.randrange(3)}) for i in range(rng.randrange(1, 5))] for b in "abc"}
        dependencies = [("a", "x", "b", "y"), ("b", "x", "c", "y")]
        allowed = [{(rng.randrange(3), rng.randrange(3)) for _ in range(4)} for _ in dependencies]
        got = branch_and_bound(candidates, dependencies, allowed)
        nothing = 1 + sum(map(len, candidates.values()))
        at = {c[0]: i for some in candidates.values() for i, c in enumerate(some)}
        assert sum(at[got[b]] if b in got else nothing for b in candidates) == exhaustive(candidates, dependencies, allowed)


def test_bundles(spark):
    rows = [("g", "3", 320, True, "ab"), ("g", "1", 320, True, None), ("g", "2", 900, False, "abc"), ("g", "2", 900, False, "abc"), ("h", "9", 1, True, "x"), (None, "5", 1, True, "x"), ("g", None, 999, True, "long text"), ("k", "7", None, None, ""), ("k", "8", None, None, None)]
    df = spark.createDataFrame(rows, "grp string, id string, rate int, there boolean, comment string")
    length = F.length(F.coalesce("comment", F.lit("")))
    got = survivors(df, F.col("grp"), "id", [Bundle("audio", F.col("there"), (F.col("rate"),)), Bundle("comment", length > 0, (length,))])
    assert {tuple(r) for r in got.collect()} == {("1", "audio", "1"), ("1", "comment", "2")}
    assert survivors(df.limit(0), F.col("grp"), "id", [Bundle("audio", F.col("there"), (F.col("rate"),))]).count() == 0


def test_dependencies_hold(spark):
    rows = [("g", "1", "Paris", "FR", 9, 1), ("g", "2", "Lyon", "FR", 5, 5), ("g", "3", "Oslo", "NO", 1, 9)]
    df = spark.createDataFrame(rows, "g string, id string, city string, land string, city_trust int, land_trust int")
    bundles = [Bundle("city", F.lit(True), (F.col("city_trust"),), {"city": F.col("city")}), Bundle("land", F.lit(True), (F.col("land_trust"),), {"land": F.col("land")})]
    free = {r.field: r.id for r in survivors(df, F.col("g"), "id", bundles).collect()}
    bound = {r.field: r.id for r in survivors(df, F.col("g"), "id", bundles, [("city", "city", "land", "land")]).collect()}
    assert free == {"city": "1", "land": "3"}
    assert bound == {"city": "1", "land": "2"}


def test_only_broken_groups_are_searched_and_all_are_right(spark):
    rng = random.Random(8)
    rows = [(f"g{g}", f"{g:02}{i}", rng.choice("xyz"), rng.randrange(4), rng.randrange(9), rng.randrange(9)) for g in range(25) for i in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "g string, id string, a string, b int, ta int, tb int")
    bundles = [Bundle("a", F.lit(True), (F.col("ta"),), {"a": F.col("a")}), Bundle("b", F.col("tb") > 0, (F.col("tb"), F.col("ta")), {"b": F.col("b")})]
    got = {}
    for r in survivors(df, F.col("g"), "id", bundles, [("a", "a", "b", "b")]).collect():
        got.setdefault(r.group_id, {})[r.field] = r.id
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        if len(mine) < 2:
            continue
        some = {"a": {}, "b": {}}
        for r in sorted(mine, key=lambda r: (-r[4], r[1])):
            some["a"].setdefault(r[2], (r[1], {"a": r[2]}))
        for r in sorted((r for r in mine if r[5] > 0), key=lambda r: (-r[5], -r[4], r[1])):
            some["b"].setdefault(r[3], (r[1], {"b": r[3]}))
        lists = {k: list(v.values()) for k, v in some.items() if v}
        pairs = {(r[2], r[3]) for r in mine if r[5] > 0}
        assert got[min(r[1] for r in mine)] == branch_and_bound(lists, [("a", "a", "b", "b")], [pairs])
