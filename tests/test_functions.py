"""Golden vectors of the scalar functions, and exhaustive checks of the key table."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setlore.functions import music, text
from setlore.functions.distance import osa_distance


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("raw, key", [("6A", "6A"), ("Fm", "4A"), ("E min", "9A"), ("08A", "8A"), ("12m", "12A"), ("7M", "7B"), ("ALL", ""), ("13A", ""), (None, ""), ("", ""), ("5", "5A"), ("Gbmaj", "2B"), ("D", "10B"), ("H", "")])
def test_normalize_key(spark, raw, key):
    assert one(spark, music.normalize_key, raw) == key


@pytest.mark.parametrize("raw, expected", [("6 - dark roller", (6, "dark roller")), ("100 x", (10, "0 x")), ("128", (None, "128")), ("6am", (6, "am")), (None, (None, "")), ("", (None, ""))])
def test_comment_energy(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "x string").select(*text.comment_energy(F.col("x"))).first()
    assert tuple(got) == expected


@pytest.mark.parametrize("title, base", [("Skyfall (Extended Mix)", "skyfall"), ("Alone Extended Mix", "alone"), ("Remix", "remix"), ("Song feat. Someone", "song"), (None, "")])
def test_base_title(spark, title, base):
    assert one(spark, text.base_title, title) == base


def test_split_title_keeps_other_songs_apart(spark):
    rows = spark.createDataFrame([("Bailando Con Lola",), ("Bailando Con Marta",), ("Bailando (Original Mix)",), ("Bailando (Club Mix)",)], "t string")
    got = [tuple(r) for r in rows.select(*text.split_title(F.col("t"))).collect()]
    assert got == [("bailando con lola", ""), ("bailando con marta", ""), ("bailando", ""), ("bailando", "club mix")]


@pytest.mark.parametrize("artist, first", [("A & B", "a"), ("A, B", "a"), ("A vs B", "a"), (None, "")])
def test_primary_artist(spark, artist, first):
    assert one(spark, text.primary_artist, artist) == first


def test_family_order(spark):
    assert one(spark, text.genre_family, "Afro House") == "House"
    assert one(spark, text.genre_family, None) == "No family"


@pytest.mark.parametrize("a, b, d", [("Reggeaton", "Reggaeton", 1), ("pop", "rap", 2), ("folk", "rock", 2), ("ca", "abc", 3)])
def test_osa(a, b, d):
    assert osa_distance(a, b) == d


@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
@settings(max_examples=200, deadline=None)
def test_osa_is_at_most_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    assert osa_distance(a, b) <= row[-1]
    assert osa_distance(a, b, 2) == min(osa_distance(a, b), 3)


def test_key_table():
    rows = music.move_rows()
    assert len(rows) == 24 * 13 and all(r[4] != 6 for r in rows)
    for src in {r[0] for r in rows}:
        assert [len({r[1] for r in rows if r[0] == src and r[3] <= level}) for level in (1, 2, 3)] == [5, 10, 13]
    shared = {0: 7, 1: 6, 2: 5, 3: 4, 4: 3, 5: 2, 6: 2}
    for src, dst, *_, notes, _ in rows:
        apart = abs(int(src[:-1]) - int(dst[:-1]))
        assert notes == shared[min(apart, 12 - apart)]


def test_bpm_distance(spark):
    got = spark.sql("SELECT 128.0D a, 64.0D b UNION ALL SELECT 100.0D, 0.0D UNION ALL SELECT 100.0D, 106.0D").select(music.bpm_distance(F.col("a"), F.col("b"))).collect()
    assert sorted([r[0] for r in got], key=str) == [0.0, 0.06, None]


def test_other_text_functions(spark):
    assert one(spark, text.safe_name, " a/b:c\\d\x07. ") == "a-b-c-d"
    assert one(spark, text.version_parts, "v1.12.3") == [1, 12, 3] and one(spark, text.version_parts, "x") is None
    assert one(spark, text.is_branding, "see www.shop.example") and not one(spark, text.is_branding, None)
    stem = spark.createDataFrame([("/m/01. Ada - Sun.mp3",)], "p string").select(*text.file_stem(F.col("p"))).first()
    assert tuple(stem) == ("Ada", "Sun")
    assert [one(spark, text.duration_label, x, "double") for x in (None, 0.0, 61.4)] == ["—", "—", "1:01"]


@pytest.mark.parametrize("title, version", [("A (Radio Remix)", "remix"), ("A (Mashup Rework)", "rework"), ("A (Live Edit)", "edit"), ("A (Extended Mix)", "extended mix"), ("A", ""), (None, "")])
def test_version_of_ties_by_list(spark, title, version):
    words = [w for w in text.VERSIONS if title and "(" in title and w in title.lower()]
    assert version == (max(words, key=len) if words else "")
    assert one(spark, text.version_of, title) == version


def test_queries_keys_and_labels(spark):
    row = spark.createDataFrame([("Sun (Club Mix)", "Ada feat. Bob", "hits 2020")], "t string, a string, b string").select(
        text.search_query(F.col("t"), F.col("a")), text.unfindable_key(F.col("a"), F.col("t"), F.lit("x")), text.is_compilation(F.col("b"), F.col("t")), text.is_compilation(F.col("b"), F.col("b")), text.unfindable_key(F.lit(None), F.lit(""), F.lit(" A  b "))).first()
    assert tuple(row) == ("Ada sun", "ada feat. bob\tsun (club mix)", True, False, "a b")
    cases = [((True, "FLAC", True, 44100, 24, None), "FLAC 44.1 kHz / 24-bit"), ((True, "FLAC", True, 48000, None, None), "FLAC 48 kHz"), ((True, "MP3", False, 44100, 16, 320000), "MP3 320 kbps"), ((True, None, None, None, None, None), "?"), ((False, "MP3", False, 1, 1, 1), "file not found")]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "e boolean, c string, l boolean, r int, d int, b int, w string")
    assert df.where(text.quality_label(*[F.col(x) for x in "eclrdb"]) != F.col("w")).count() == 0


def test_frames(spark):
    cases = [
        ("ID3", "TIT2", "www.shop.com", ""), ("ID3", "WOAF", "x", "brand"), ("ID3", "WOAF", " ", ""), ("ID3", "WXXX:a", "x", "brand"), ("ID3", "TALB", "www.shop.com", "album"), ("ID3", "TALB", "Album", ""), ("ID3", "COMM::eng", "promo only", "brand"),
        ("ID3", "TENC", "LAME", ""), ("ID3", "TENC", "dj pool", "brand"), ("ID3", "TXXX:Serato x", "www.a.com", ""), ("ID3", "TXXX:pool-user", "me", "brand"), ("ID3", "APIC:", "", "cover"), ("Vorbis", "publisher", "x", "brand"), ("Vorbis", "copyright", "x", ""), ("Vorbis", "album", "music master", "album"),
        ("MP4", "covr", "", "cover"), ("MP4", "©cmt", "www.a.com", "brand"), ("MP4", "©alb", "www.a.com", "album"), ("MP4", "----:com.serato", "www.a.com", ""), ("MP4", "----:x", "www.a.com", "brand"), ("MP4", "WOAF", "x", ""),
    ]
    df = spark.createDataFrame(cases, "kind string, key string, value string, want string")
    assert df.where(text.frame_kind(F.col("kind"), F.col("key"), F.col("value")) != F.col("want")).collect() == []


def test_key_parts(spark):
    got = {c: tuple(spark.createDataFrame([(c,)], "c string").select(*music.key_parts(F.col("c"))).first()) for c in ("8B", "8A", "1A", "12B", "13A", "")}
    assert got == {"8B": (0, "major"), "8A": (9, "minor"), "1A": (8, "minor"), "12B": (4, "major"), "13A": (None, None), "": (None, None)}
