"""Grids, plans, comments, models, descriptors, analysis files, exports and streams."""

from __future__ import annotations

from itertools import product

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from setlore.operators import learning, playing, signal
from setlore.sources import analysis, export, references
from setlore.streaming import changes


def test_phrase_seconds_clamp_and_body_does_not(spark):
    grids = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [])], "id string, beats array<double>")
    phrases = spark.createDataFrame([("a", 0, 1, 0, 1), ("a", 1, 2, 9, 1), ("b", 0, 2, 1, 1)], "id string, pos int, kind int, beat int, mood int")
    assert {(r.kind, r["at"]) for r in playing.phrase_seconds(phrases, grids).collect()} == {(1, 1.0), (2, 3.0)}
    assert [tuple(r) for r in playing.body_start(phrases.where("id = 'a'"), grids).collect()] == [("a", None)]


def test_slice_means(spark):
    frames = spark.createDataFrame([("a", float(t), float(t * t)) for t in range(6)], "id string, t double, x double")
    edges = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 2.5), ("a", 5.5), ("a", 9.0)], "id string, at double")
    assert {r.i: r["mean"] for r in playing.slice_means(frames, edges).collect()} == {0: 0.5, 1: 4.0, 2: pytest.approx(50 / 3), 3: 0.0}


def test_tempo_marks(spark):
    beats = [(i * 0.5, 120.0, i % 4 + 1) for i in range(6)] + [(3.2, 120.0, 3), (3.7, 120.0, 4), (4.1, 140.0, 1)]
    df = spark.createDataFrame([(beats,)], "b array<struct<at:double,bpm:double,beat:int>>")
    assert [m["at"] for m in df.select(playing.tempo_marks(F.col("b"))).first()[0]] == [0.0, 3.2, 4.1]


def test_mix_plan(spark):
    grid = [i * 0.5 for i in range(400)]
    rows = [("x", 120.0, grid, [0.0, 100.0, 180.0], 122.0, grid, [(1, 0.0), (2, 16.0)]), ("y", 120.0, [], [], 90.0, grid, []), ("z", 120.0, grid[:20], [1.0], 120.0, grid, [])]
    df = spark.createDataFrame(rows, "id string, bpm_a double, grid_a array<double>, marks_a array<double>, bpm_b double, grid_b array<double>, phrases_b array<struct<kind:int,at:double>>")
    got = {r.id: r for r in playing.mix_plan(df).collect()}
    assert (got["x"].out_at, got["x"].blend, got["x"].intro, got["x"].usable) == (100.0, 64.0, 16.0, True)
    assert got["y"].out_at is None and not got["y"].usable and got["y"].tempo_note == "too far"
    assert got["z"].out_at == 0.0


@pytest.mark.parametrize("comments, merged", [(["6", "6 - rock groove"], "6 - rock groove"), (["6 - a", "7 - b", "6 - A"], "6 - a · b (energy 7 on the other copy)"), ([None, ""], None), (["x", "3"], "3 - x")])
def test_merge_comments(spark, comments, merged):
    df = spark.createDataFrame([(comments,)], "c array<string>")
    assert df.select(playing.merge_comments(F.col("c"))).first()[0] == merged


def test_models(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{i:03}", [float(a), float(b)], int(a + 0.3 * b > 0), 1.0, True) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    df = learning.standardise(spark.createDataFrame(rows, "id string, features array<double>, y int, w double, real boolean"), "features")
    assert df.select(F.avg(F.get("features", F.lit(0)))).first()[0] == pytest.approx(0, abs=1e-9)
    penalty, auc = learning.cross_validate(df, "features", (1.0, 100.0), folds=2)
    assert auc > 0.9 and penalty in (1.0, 100.0)
    assert learning.cross_validate(df.where("y = 1"), "features", (1.0,)) is None
    assert learning.explain(["a", "b", "c"], [0.5, -0.9, 0.001]) == [("b", -0.9), ("a", 0.5)]
    assert {r.name for r in learning.contributions(df, "features", ["a", "b"], [1.0, 0.0]).collect()} == {"a"}
    pairs = spark.createDataFrame([("000", "001")], "winner string, loser string")
    assert sorted(r.y for r in learning.pair_rows(pairs, df).collect()) == [0, 1]


def test_training_rows(spark):
    ids = spark.createDataFrame([(f"{i:03}",) for i in range(200)], "id string")
    pick = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    rows = learning.training_rows(ids, pick("000", "001"), pick("002", "001"), pick("002", "003")).collect()
    by = {r.id: r for r in rows}
    assert (by["000"].y, by["001"].y, by["003"].y, by["002"].y) == (1, 1, 1, 0) and len(rows) == 64
    assert sum(r.w for r in rows if r.y) == pytest.approx(sum(r.w for r in rows if not r.y))


def test_descriptors(spark):
    t = np.arange(22050 * 2) / 22050
    tone = np.sin(2 * np.pi * 440 * t).astype(float).tolist()
    df = spark.createDataFrame([("a", tone), ("b", [0.0] * 5000), ("c", []), ("d", None)], "id string, pcm array<double>")
    got = {r.id: r for r in signal.descriptors(df, "id", "pcm").collect()}
    assert set(got) == {"a", "b", "c"} and int(np.argmax(got["a"].notes)) == 9
    assert got["a"].centroid == pytest.approx(440, rel=0.2) and got["b"].loud == 0.0 and got["c"].seconds == 0.0


def test_chords_follow_the_notes(spark):
    templates = signal.chord_templates()
    c, am = signal.CHORDS.index((0, False)), signal.CHORDS.index((9, True))
    notes = np.vstack([[templates[c]] * 8, [templates[am]] * 8, np.zeros((4, 12))])
    bass = np.zeros((20, 12))
    bass[:8, 0], bass[8:16, 9] = 1, 1
    assert signal.chords(notes, bass) == [c] * 8 + [am] * 8 + [-1] * 4
    df = spark.createDataFrame([("x", notes.tolist(), bass.tolist())], "id string, notes array<array<double>>, bass array<array<double>>")
    assert signal.chord_rows(df).count() == 20
    assert {signal.CHORDS[i] for i in signal.chords_of_key(9, True)} == {(9, True), (11, True), (0, False), (2, True), (4, True), (4, False), (5, False), (7, False)} - {(11, True)}
    both = np.array([[1.0, 0, 0, 0.6, 0.61, 0, 0, 1.0, 0, 0, 0, 0]] * 6)
    assert signal.CHORDS[signal.chords(both, np.zeros((6, 12)))[0]] == (0, False) and signal.CHORDS[signal.chords(both, np.zeros((6, 12)), (0, True))[0]] == (0, True)


def test_the_steady_path_is_the_most_likely_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        seen = rng.normal(size=(5, 4))
        best = max(product(range(4), repeat=5), key=lambda p: sum(seen[i, s] for i, s in enumerate(p)) + sum(np.log(0.7 if a == b else 0.1) for a, b in zip(p, p[1:])))
        assert signal.steady_path(seen, 0.7) == list(best)


def analysis_file():
    wave = b"PWV6" + struct.pack(">IIII", 20, 26, 3, 2) + bytes([1, 2, 3, 4, 5, 6])
    grid = b"PQTZ" + struct.pack(">II", 12, 28) + struct.pack(">HHI", 1, 12800, 500) + struct.pack(">HHI", 2, 12800, 969)
    return b"HEAD" + struct.pack(">I", 8) + wave + grid


def test_analysis_files(spark, tmp_path):
    assert [s[0] for s in analysis.sections(analysis_file())] == ["PWV6", "PQTZ"] and analysis.sections(b"x") == []
    (tmp_path / "a.bin").write_bytes(analysis_file())
    (tmp_path / "b.bin").write_bytes(b"short")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-5:]: r for r in analysis.read_analysis(files).collect()}
    assert (got["a.bin"].low, got["a.bin"].high) == ([1, 4], [3, 6]) and got["a.bin"].beats[1]["bpm"] == 128.0
    assert got["b.bin"].low is None and got["b.bin"].beats == []


def test_references_pages_and_listing(spark, tmp_path):
    blob = b"\x00/Contents/Ada/Sun.mp3\x00\x01/Contents/no/end\x02/Contents/Ada/Sun.mp3/Contents/B/x.FLAC"
    df = spark.createDataFrame([(1, bytearray(blob)), (2, None)], "id int, content binary")
    assert {r.path for r in references.device_paths(df, "id", "content").collect()} == {"/Contents/Ada/Sun.mp3", "/Contents/B/x.FLAC"}
    page = '<html><script type="application/json">{"tracks":[{"title":"T","artist":"A","url":"u"},{"title":"S"}]}</script>'
    pages = spark.createDataFrame([(1, page), (2, "<html>"), (3, None)], "page_id int, html string")
    assert [(r.page_id, r.pos, r.title) for r in analysis.page_songs(pages, "html").collect()] == [(1, 0, "T"), (1, 1, "S")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.flac").write_bytes(b"12")
    (tmp_path / "x" / "b.txt").write_bytes(b"12")
    assert [(r.path[-6:], r.size) for r in analysis.audio_files(spark, str(tmp_path)).collect()] == [("a.flac", 2)]


def test_exports(spark, tmp_path):
    track = spark.read.parquet("/root/testdata/sf0.001/track.parquet")
    export.dump_tables({"track": track.select("id", "title")}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/track")).count() == track.count()
    export.collection_xml(track, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "track").load(str(tmp_path / "xml")).count() == track.count()


def test_streams(spark, tmp_path):
    rows = [(1, "set_comment", "t", None, None, "a", "old"), (2, "set_comment", "t", None, None, "b", "a"), (3, "add_tag", "t", "x", None, None, None)]
    spark.createDataFrame(rows, "seq long, op string, track string, tag string, playlist string, value string, before string").write.parquet(str(tmp_path / "log"))
    schema = spark.read.parquet(str(tmp_path / "log")).schema
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    changes.compact_stream(log, str(tmp_path / "out"), str(tmp_path / "state"), "compaction").awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.field, r.value, r.before) for r in got} == {("comment", "b", "old"), ("tag:x", None, None)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    assert changes.windowed_counts(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_progressions(spark):
    am, f, c, g = (signal.CHORDS.index(k) for k in ((9, True), (5, False), (0, False), (7, False)))
    loop = [am, f, c, g] * 12
    assert signal.progression(loop, 9) == {"loop": [[am, 1], [f, 1], [c, 1], [g, 1]], "coverage": 1.0, "moves": True}
    assert signal.progression([f, c, g, am] * 12, 9)["loop"] == [[am, 1], [f, 1], [c, 1], [g, 1]]
    assert signal.progression([c, am, am, c] * 12, 9)["loop"] == [[am, 2], [c, 2]]
    assert signal.progression([am] * 40, 9) == {"loop": [[am, 1]], "coverage": 1.0, "moves": False}
    assert signal.progression([-1, am], 9)["loop"] == [] and not signal.progression([am, f, c, g] * 4 + [am] * 32, 9)["moves"]
    df = spark.createDataFrame([("a", 9, loop), ("b", 0, None)], "id string, tonic int, bars array<int>")
    assert {(r.id, r.moves) for r in signal.progressions(df).collect()} == {("a", True), ("b", False)}


def test_briefs(spark):
    schema = "id string, error string, key struct<name:string,camelot:string>, scale struct<name:string>, prog struct<loop:array<struct<chord:string,num:string,bars:int>>,moves:boolean>"
    rows = [("a", None, ("Am", "8A"), ("Aeolian",), ([("Am", "i", 2)], True)), ("b", "broken", ("Am", "8A"), None, None), ("c", None, None, None, None), ("d", None, ("C", "8B"), ("Ionian",), None)]
    got = {r.id: tuple(r)[1:] for r in signal.briefs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("Am", "8A", "Aeolian", True, "i Am 2"), "b": (None,) * 5, "c": (None,) * 5, "d": ("C", "8B", "Ionian", False, "")}


def test_reports_and_ablation(spark):
    rows = [(f"{i:03}", [float(i % 2) + (i % 7) / 50, float(i % 5)], i % 2, 1.0, True) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, features array<double>, y int, w double, real boolean")
    report = learning.training_report(df, "features", (1.0,))
    assert (report["yes"], report["no"], report["base"], report["proxy"]) == (30, 30, 0.5, False) and report["auc"] > 0.95 and report["verdict"] == "strong"
    alone = learning.ablation(df, "features", {"good": [0], "noise": [1]}, 1.0)
    assert alone["good"] > 0.95 > alone["noise"]
    assert learning.training_report(df.where("y = 1"), "features", (1.0,))["verdict"] == "too-few"


def test_phrase_sections():
    entries = b"".join(struct.pack(">HHH18x", i + 1, beat, kind) for i, (kind, beat) in enumerate([(1, 1), (2, 33), (6, 65)]))
    body = struct.pack(">IHH", 24, 3, 2) + b"\0" * 12 + entries
    data = b"HEAD" + struct.pack(">I", 8) + b"PSSI" + struct.pack(">II", 32, 12 + len(body)) + body
    assert analysis.phrase_entries(data) == (2, [(1, 1), (2, 33), (6, 65)])
    assert analysis.phrase_entries(data[:60]) is None and analysis.phrase_entries(b"") is None
