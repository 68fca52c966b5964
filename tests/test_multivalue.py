"""The packed-field grammar: goldens, malformed input and edge cases."""

from __future__ import annotations

from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setlore.operators.multivalue import ARTISTS, GENRES, Grammar, Parser, split_values

NAMES = ("House", "R&B", "Drum & Bass", "Dub, Steppers & Roots", "Latin Jazz")
GENRE = Parser(replace(GENRES, names=NAMES))
ARTIST = Parser(ARTISTS)


def values(parser, text):
    return [v.value for v in parser.parse(text)]


@pytest.mark.parametrize("text, expected", [
    ("House/Hip Hop", ["House", "Hip Hop"]),
    ("House;Dub, Steppers & Roots|R&B", ["House", "Dub, Steppers & Roots", "R&B"]),
    ("drum & bads, House", ["drum & bads", "House"]),
    ("dub, stepperse& roots / Soul", ["dub, stepperse& roots", "Soul"]),
    ("Jazz, Latin", ["Jazz, Latin"]),
    ("Jazz, Soul", ["Jazz", "Soul"]),
    ('"R&B", ,Trance', ["R&B", "Trance"]),
    ("Grime.\nUK Garage\tHouse", ["Grime.", "UK Garage", "House"]),
    ("Rock (Indie, Pop) / Folk", ["Rock (Indie, Pop)", "Folk"]),
    ("Disco + Soul & Funk", ["Disco", "Soul", "Funk"]),
    ("; House / ", ["House"]),
    ("", []), (None, []), ("  ", []), (" / ; ", []),
])
def test_genres(text, expected):
    assert values(GENRE, text) == expected


@pytest.mark.parametrize("text, expected", [
    ('"Samuel the ""Paper"" Moon" vs Liv', ['Samuel the "Paper" Moon', "Liv"]),
    ("A B ft. C D x E", ["A B", "C D", "E"]),
    ("Max Mix featuring Xena", ["Max Mix", "Xena"]),
    ("Ada & Bo, Cy FEAT. Di", ["Ada", "Bo", "Cy", "Di"]),
    ('"Open quote / Next', ['"Open quote', "Next"]),
    ('"Half" open / "Whole"', ['"Half" open', "Whole"]),
    ("Same / Same", ["Same", "Same"]),
    ("Plain Name", ["Plain Name"]),
])
def test_artists(text, expected):
    assert values(ARTIST, text) == expected


def test_malformed_quotes_are_flagged():
    assert [v.malformed for v in ARTIST.parse('"Open quote / Next')] == [True, False]
    assert not any(v.malformed for v in ARTIST.parse('"Good" / Next'))


@given(st.lists(st.text(alphabet="abc XYZ", min_size=1, max_size=8).filter(lambda s: s.strip()), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_quoted_values_come_back(parts):
    text = "/".join('"' + p.replace('"', '""') + '"' for p in parts)
    assert values(Parser(Grammar()), text) == [p.strip() for p in parts]


def test_operator_edges(spark):
    rows = [("1", "a/b", None, 5), ("1", "a/b", None, 5), ("2", None, "", 6), (None, "x;y", "q", 7), ("3", "single", "a ft. b", 8), ("4", "z/" * 40000, None, 9)]
    df = spark.createDataFrame(rows, "id string, genre string, artist string, field int")
    got = split_values(df, "id", {"genre": GENRES, "artist": ARTISTS}, several_only=True)
    out = [(r.id, r.field, r.pos, r.value) for r in got.collect()]
    assert out.count(("1", "genre", 1, "a")) == 2
    assert (None, "genre", 2, "y") in out
    assert ("3", "artist", 2, "b") in out and not any(r[:2] == ("3", "genre") for r in out)
    assert sum(r[0] == "4" for r in out) == 40000
    assert split_values(df.limit(0), "id", {"genre": GENRES}).count() == 0
