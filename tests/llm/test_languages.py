from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF

from setlore.llm import languages as op

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def profiles(spark):
    return op.fit(op.sample(spark.read.parquet(f"{LARGER}/documents.parquet"), "doc_id", "text", "lang"))


def test_sentences():
    text = "30. Ada Moon – Late Light (7B, 120)\n2024-01-02 / 03:04\nThis is one. Is this two?  1234 Low_Sun.mp3 -> /Music/2020-01/\n[CLS]\nこれは日本語の文です。もう一つの文です。 ??? 12."
    assert op.sentences(text) == ["This is one.", "Is this two?", "これは日本語の文です。", "もう一つの文です。"]
    assert op.sentences(None) == op.sentences("") == op.sentences(" \n ") == []


def test_held_out_accuracy(spark, profiles):
    """Documents of another table, in one language after the label: nearly all agree; some labels are wrong."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(f"lang IN {op.LANGUAGES}")
    found = op.documents(op.segments(docs, "doc_id", "text", profiles), "doc_id").where("languages = 1").withColumnRenamed("lang", "found")
    rows = [(r["found"], r["label"]) for r in found.join(docs.selectExpr("doc_id", "lang label"), "doc_id").collect()]
    assert len(rows) > 50
    assert sum(a == b for a, b in rows) / len(rows) > 0.8
    assert Counter(a for a, _ in rows).most_common(1)[0][0] == "en"


def test_switches_and_edges(spark, profiles):
    two = "Nobody on the floor noticed that the bass had been gone for a while. The left channel is quieter than the right one.\n12. Ada – Sun (1A, 99)\nAl principio de la noche, mi amiga escuchó la versión sin voces. El canal izquierdo suena más bajo que el derecho."
    rows = [(1, two, "x", 0.5), (2, None, "x", 0.5), (3, "", "x", 0.5), (4, "1234 -> /x/", "x", 0.5), (1, two, "x", 0.5), (5, "This one is only a sentence. " * 3000, "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence double")
    got = [(r.doc_id, r.seg, r.lang) for r in op.segments(df, "doc_id", "text", profiles).collect()]
    assert sorted(got) == sorted([(1, 1, "en"), (1, 2, "es")] * 2 + [(5, 1, "en")])
    assert all(0 < r.confidence <= 1 for r in op.segments(df, "doc_id", "text", profiles).collect())
    assert op.segments(df.limit(0), "doc_id", "text", profiles).count() == 0


def test_nothing_to_learn_from(spark):
    empty = op.fit([])
    df = spark.createDataFrame([(1, "Some text with words.")], "doc_id long, text string")
    assert op.segments(df, "doc_id", "text", empty).count() == 1


def test_every_document_has_a_row(spark, profiles):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "30. Ada - Moon"), (4, "This is the long night. Das ist die lange Nacht und sie endet nie."), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.documents(op.segments(df, "doc_id", "text", profiles, every=True), "doc_id").collect()}
    assert {k: (r.lang, r.languages, r.stretches) for k, r in got.items()} == {1: ("und", 0, 0), 2: ("und", 0, 0), 3: ("und", 0, 0), 4: ("de", 2, 2)}
    assert got[1].confidence == 0 and got[4].confidence > 0.5
