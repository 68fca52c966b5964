from __future__ import annotations

import pytest

from setlore.llm.unicode_form import clean_text

CASES = {
    "plain": "plain", "": "", "Déjà\tvu\n": "Déjà\tvu\n", "Ночной вокзал": "Ночной вокзал", "Νύχτα στο λιμάνι": "Νύχτα στο λιμάνι", "ガラス": "ガラス", "“Don’t” – a": "“Don’t” – a",
    "Déjà": "Déjà", "Ｌive ２": "Live 2", "ON HOLD": "ON HOLD", "a​b­c﻿": "abc", "SORTΕD": "SORTED", "Параd": "Парad",
    "ﬁne": "fine", "ガラス": "ガラス", "Ｅ́": "É", "Νсі House": "Nci House", "ОН it": "OH it", "a b　c": "a b c", "x\u0000y": "xy", "\U0001d400b": "Ab", "ｶ": "カ",
    "Ночнoй": "Ночной", "ᎪᎪᎢ live": "AAT live", "ꓐꓑn": "BPn", "gɑme": "game", "x² ① ½ a‐b 5−3": "x² ① ½ a‐b 5−3", "mıx": "mıx", "ⅣǄĲ": "IVDŽIJ", "𝟘": "0", "ꓐꓲ": "ꓐꓲ", "ⲞⲢ set": "OP set",
}


def test_tables_pair_up():
    from setlore.llm import unicode_form as u

    for name in ("CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE", "LISU", "PHONETIC"):
        letters, twins = getattr(u, name), getattr(u, name + "_AS")
        assert len(letters) == len(twins) == len(set(letters)) and twins.isascii()


def test_cases(spark):
    rows = [(str(i), k, "clash", "field") for i, k in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id string, title string, value string, clean string")
    got = {r.value: r.clean for r in clean_text(df, "id", ["title"]).collect()}
    want = {k: v for k, v in CASES.items() if k != "Параd"}
    assert {k: got[k] for k in want} == want
    changed = {r.value for r in clean_text(df, "id", ["title"], changed_only=True).collect()}
    assert changed == {k for k in got if got[k] != k}


@pytest.mark.parametrize("changed_only", [False, True])
def test_edges(spark, changed_only):
    df = spark.createDataFrame([("1", None, "a​"), ("1", None, "a​"), (None, "x" * 300_000 + "ａ", "")], "id string, title string, artist string")
    got = clean_text(df, "id", ["title", "artist"], changed_only).collect()
    assert sum(r.field == "artist" and r.clean == "a" for r in got) == 2
    long = [r for r in got if r.field == "title"]
    assert len(long) == 1 and long[0].clean == "x" * 300_000 + "a"
    assert clean_text(df.limit(0), "id", ["title"], changed_only).count() == 0


def test_is_stable(spark):
    df = spark.createDataFrame([(str(i), k) for i, k in enumerate(CASES)], "id string, title string")
    once = clean_text(df, "id", ["title"]).select("id", "clean")
    assert clean_text(once, "id", ["clean"], changed_only=True).count() == 0
