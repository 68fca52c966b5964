from __future__ import annotations

import random

import pytest

from setlore.llm import tokenizer as op

TEXTS = ["", "Hello world", "aaaa aaa aa a", "<|endoftext|> stays text", "  two  blanks\n\n\tand tabs ", "naïve Ünï 日本語 привет 👩‍🎤", "don't we'll I'd 123456 7e8", "\x00\x1b﻿", "x" * 50_000, "ab" * 30_000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{op.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_library(spark, reference):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("aeiou tnrs.,'\n0é") for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in op.encode(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a")], "doc_id long, text string")
    rows = op.encode(df, "doc_id", "text").collect()
    assert len(rows) == 5 and {r.doc_id: r.ids for r in rows}[1] == [] and {r.doc_id: r.ids for r in rows}[2] == []
    counts = {r.doc_id: r.n_tokens for r in op.count_tokens(df, "text", ["doc_id"]).collect()}
    assert counts == {1: 0, 2: 0, 3: 2, None: 1}
    assert op.encode(df.limit(0), "doc_id", "text").count() == 0


def test_round_trip(reference):
    import json

    replay = op.Replay(op.read_definition())
    letters = op.byte_letters()
    vocabulary = {i: t for t, i in json.loads(op.read_definition())["model"]["vocab"].items()}
    for text in TEXTS[1:8]:
        ids = replay.encode([text])[0]
        assert bytes(letters[c] for i in ids for c in vocabulary[i]).decode() == text
