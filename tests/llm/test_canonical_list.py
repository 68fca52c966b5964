from __future__ import annotations

import random

from pyspark.sql import functions as F

from setlore.llm import canonical_list as op

GENRES = [(1, "House"), (2, "Deep House"), (3, "R&B"), (4, "Drum & Bass"), (5, "UK Garage"), (6, "Latin Jazz"), (7, "Disco"), (8, "Soundtrack"), (9, "Nu Disco"), (10, "Electronica")]
KEYS = [(1, "1A", "Abm"), (4, "4A", "Fm"), (8, "8A", "Am"), (9, "9A", "Em"), (13, "1B", "B"), (20, "8B", "C"), (23, "11B", "A"), (12, "12A", "Dbm"), (19, "7B", "F"), (24, "12B", "E")]
CASES = {
    "genres": {"house": 1, "hose": 1, "Houlse": 1, " House ": 1, "deephouse": 2, "Deep Hse": 2, "R'n'B": 3, "r and b": 3, "RnB": 3, "drum n bass": 4, "DnB": 4, "Drum & aBss": 4, "U.K. Garage": 5, "UKG": 5, "Jazz, Latin": 6, "Garage (UK)": 5, "Dicso": 7, "O.S.T. Soundtrack": 8, "New Disco": 9, "Electrónica": 10, "misc": 0, "???": 0, "to sort": 0, "x": 0, " ": 0},
    "key": {"G# min": 1, "g#m": 1, "A♭ minor": 1, "01a": 1, "Key 1A": 1, "1m": 1, "7M": 19, "Cb mjor": 13, "B# majro": 20, "C#mni": 12, "E mnor": 9, "am": 8, "A MINOR": 8, " A": 23, "Fb": 24, "ALL": 0, "13A": 0, "14m": 0, "128": 0, "atonal": 0, "drums only": 0, "Xm": 0, "-": 0},
}


def tables(spark):
    return spark.createDataFrame(GENRES, "entry int, name string"), spark.createDataFrame(KEYS, "entry int, camelot string, scale_name string")


def test_cases(spark):
    rows = [(f"{f}{i}", f, i, v, 99, "clash") for f, some in CASES.items() for i, v in enumerate(some, 1)]
    df = spark.createDataFrame(rows, "id string, field string, pos int, value string, entry int, spelling string")
    got = {r.id: r.entry for r in op.map_values(df, *tables(spark)).collect()}
    wrong = {(f, v): (got[f"{f}{i}"], want) for f, some in CASES.items() for i, (v, want) in enumerate(some.items(), 1) if got[f"{f}{i}"] != want}
    assert not wrong


def test_edges(spark):
    df = spark.createDataFrame([("1", "genres", 1, None), ("1", "genres", 2, ""), ("1", "genres", 3, "disco"), ("1", "genres", 3, "disco"), (None, "key", 1, "Fm"), ("2", "genres", 1, "z" * 100_000)], "id string, field string, pos int, value string")
    got = sorted(((r.id, r.field, r.pos, r.entry) for r in op.map_values(df, *tables(spark)).collect()), key=str)
    assert got == sorted([("1", "genres", 3, 7), ("1", "genres", 3, 7), (None, "key", 1, 4), ("2", "genres", 1, 0)], key=str)
    genre, key = tables(spark)
    assert op.map_values(df.limit(0), genre, key).count() == 0
    assert {r.entry for r in op.map_values(df, genre.limit(0), key.limit(0)).collect()} == {0}


def test_prefix_join_loses_nothing(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8)))
    left, right = sorted({word() for _ in range(60)}), sorted({word() for _ in range(40)})
    token = lambda ws, extra: op.with_tokens(spark.createDataFrame([("genres", "", w) for w in ws], "field string, part string, spelling string")).select("*", *extra)
    a = token(left, [F.col("spelling").alias("vid")]).drop("part")
    b = token(right, [F.col("spelling").alias("rid"), F.lit(1).alias("entry")]).drop("part")
    sets = lambda df: {r.spelling: set(r.tokens) for r in df.collect()}
    x, y = sets(a), sets(b)
    want = {(p, q) for p in x for q in y if len(x[p] & y[q]) / len(x[p] | y[q]) >= 0.4}
    assert {(r.spelling, r.ref_spelling) for r in op.similarity_join(a, b, 0.4).collect()} == want
