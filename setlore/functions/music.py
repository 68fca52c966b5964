"""Keys and tempo: normalising, the table of moves, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Semitone of each note letter, and the semitones of a major scale and of the triads.
NOTES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SCALE = (0, 2, 4, 5, 7, 9, 11)
# Moves as (name, steps round the wheel for A keys, does the letter change, level); a changed sign for B keys where `turns`.
MOVES = (
    ("same", 0, False, False, 1), ("relative", 0, False, True, 1), ("fifth", 1, False, False, 1), ("fourth", -1, False, False, 1), ("mediant", -1, True, True, 1),
    ("tone_up", 2, False, False, 2), ("tone_down", -2, False, False, 2), ("diag", 1, True, True, 2), ("fourth_mode", 2, True, True, 2), ("semitone_soft", -2, True, True, 2),
    ("third_up", -3, False, False, 3), ("third_down", 3, False, False, 3), ("parallel", 3, True, True, 3),
)


def camelot_of(pitch: int, minor: bool) -> str:
    """The Camelot code of a key: fifths up from 8B (C major) and 8A (A minor)."""
    number = ((pitch - (9 if minor else 0)) * 7 + 7) % 12 + 1
    return f"{number}{'A' if minor else 'B'}"


def normalize_key(raw: Column) -> Column:
    """A key in any notation as a Camelot code, '' if it is none.

    '6A', '08A', '12m', '7M' (a capital M at the end is major), a bare number (minor), 'Fm', 'E min', 'Gbmaj', 'D'.
    """
    trimmed = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    s = F.replace(F.upper(trimmed), F.lit(" "), F.lit(""))
    code = r"^0?(\d{1,2})([ABM])?$"
    number, letter = F.regexp_extract(s, code, 1).try_cast("int"), F.regexp_extract(s, code, 2)
    side = F.when(letter == "M", F.when(trimmed.endswith("M"), "B").otherwise("A")).when(letter == "", "A").otherwise(letter)
    note = r"^([A-G])([#B]?)(.*)$"
    step, sign, rest = F.regexp_extract(s, note, 1), F.regexp_extract(s, note, 2), F.regexp_extract(s, note, 3)
    pitch = F.lit(None).cast("int")
    for name, value in NOTES.items():
        pitch = F.when(step == name, value).otherwise(pitch)
    known = ~F.concat(step, sign).isin("E#", "B#", "CB", "FB")
    pitch = F.pmod(pitch + F.when(sign == "#", 1).when(sign == "B", -1).otherwise(0), F.lit(12))
    minor, major = rest.startswith("MIN") | (rest == "M"), rest.startswith("MAJ") | (rest == "")
    wheel = F.pmod((pitch - F.when(minor, 9).otherwise(0)) * 7 + 7, F.lit(12)) + 1
    named = F.when(known & (minor | major), F.concat(wheel.cast("string"), F.when(minor, "A").otherwise("B"))).otherwise("")
    return F.when((s == "") | (s == "ALL"), "").when(s.rlike(code), F.when(number.between(1, 12), F.concat(number.cast("string"), side)).otherwise("")).when(s.rlike(note), named).otherwise("")


def key_parts(code: Column) -> tuple[Column, Column]:
    """(tonic 0..11 from C, 'major' or 'minor') of a Camelot code; nulls where it is none."""
    form = r"^([1-9]|1[0-2])([AB])$"
    number, minor = F.regexp_extract(code, form, 1).try_cast("int"), F.regexp_extract(code, form, 2) == "A"
    ok = code.rlike(form)
    return F.when(ok, F.pmod((number - 8) * 7 + F.when(minor, 9).otherwise(0), F.lit(12)).cast("int")), F.when(ok, F.when(minor, "minor").otherwise("major"))


def _notes(number: int) -> set[int]:
    return {(7 * (number - 8) + s) % 12 for s in SCALE}


def _tonic(number: int, letter: str) -> int:
    return (7 * (number - 8) - (3 if letter == "A" else 0)) % 12


def _triad(number: int, letter: str) -> set[int]:
    t = _tonic(number, letter)
    return {t, (t + (3 if letter == "A" else 4)) % 12, (t + 7) % 12}


def move_rows() -> list[tuple[str, str, str, int, int, int, int]]:
    """(src, dst, move, level, semitones, notes, triad): 24 keys times 13 moves."""
    rows = []
    for letter in "AB":
        for number in range(1, 13):
            for name, steps, turns, flips, level in MOVES:
                to = (number - 1 + (steps if letter == "A" or not turns else -steps)) % 12 + 1
                side = {"A": "B", "B": "A"}[letter] if flips else letter
                rows.append((f"{number}{letter}", f"{to}{side}", name, level, (_tonic(to, side) - _tonic(number, letter)) % 12, len(_notes(number) & _notes(to)), len(_triad(number, letter) & _triad(to, side))))
    return rows


def key_moves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(move_rows(), "src string, dst string, move string, level int, semitones int, notes int, triad int")


def bpm_distance(a: Column, b: Column) -> Column:
    """Tempo difference relative to a, the least of full, double and half time; null if one is null or 0."""
    return F.when((F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0), F.least(F.abs(a - b), F.abs(a - b * 2), F.abs(a - b * 0.5)) / a)


def tempo(raw: Column) -> Column:
    """Beats per minute from a value that may be times one hundred."""
    return F.when(raw > 1000, F.round(raw / 100, 1)).otherwise(F.coalesce(raw, F.lit(0.0)))
