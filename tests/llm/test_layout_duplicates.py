from __future__ import annotations

from collections import defaultdict
from itertools import combinations

from setlore.llm.layout_duplicates import copies, pairs

ROWS = [
    ("1", "Sun Rise", "Ada Moon"), ("2", "SUN-RISE!", "  ada\tmoon "), ("3", "ada moon", "Sun Rise"), ("4", "SunRise", "AdaMoon"), ("5", "Sun Risé", "Ada Moon"), ("6", "Sun Risé", "Ada Moon"),
    ("7", None, "Ada Moon"), ("8", "", "Ada Moon"), ("9", "???", "Ada Moon"), ("10", "Straße", "B"), ("11", "STRASSE", "b"), ("12", "a b", "c"), ("13", "a", "b c"), (None, "Sun Rise", "Ada Moon"), ("2", "SUN-RISE!", "  ada\tmoon "),
]


def test_pairs_and_copies(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "id string, title string, artist string, key string, group_id string")
    got = {(r.id_a, r.id_b) for r in pairs(df, "id", ["title", "artist"]).collect()}
    assert got == set(combinations(["1", "2", "3", "4"], 2)) | {("10", "11")} | {("5", "6")}
    assert {(r.group_id, r.copies) for r in copies(df, "id", ["title", "artist"]).collect()} == {("1", 6), ("10", 2), ("5", 2)}


def test_one_group_holds_a_third(spark):
    rows = [(f"h{i:04}", "Hot", "Group") for i in range(1300)] + [(f"s{i:04}", f"t{i // 2}", "Other") for i in range(2600)]
    df = spark.createDataFrame(rows, "id string, title string, artist string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = pairs(df, "id", ["title", "artist"])
        by = defaultdict(int)
        for r in got.groupBy(got.id_a.substr(1, 1).alias("k")).count().collect():
            by[r[0]] = r[1]
        assert by == {"h": 1300 * 1299 // 2, "s": 1300}
        assert got.count() == got.distinct().count()
        assert {r.copies for r in copies(df, "id", ["title", "artist"]).collect()} == {1300, 2}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_long(spark):
    df = spark.createDataFrame([("a", "x" * 200_000, "y"), ("b", "X" * 200_000, "y.")], "id string, title string, artist string")
    assert pairs(df, "id", ["title", "artist"]).count() == 1
    assert pairs(df.limit(0), "id", ["title", "artist"]).count() == 0
    assert copies(df.limit(0), "id", ["title", "artist"]).count() == 0
