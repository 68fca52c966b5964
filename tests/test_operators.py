"""Operators against sequential walks and on edge cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from setlore.operators import affinity, graph, journal, library, matching, measures, quality, vocabulary


def test_transitions_skip_equal_neighbours_and_do_not_bridge(spark):
    rows = [("s", "2024", 1, "A"), ("s", "2024", 2, "B"), ("s", "2024", 3, "B"), ("s", "2024", 4, "C"), ("s", "2024", 0, "Z")]
    got = library.transitions(spark.createDataFrame(rows, "session string, day string, trackno int, content string"))
    assert {(r.src, r.dst, r.n) for r in got.collect()} == {("Z", "A", 1), ("A", "B", 1), ("B", "C", 1)}


def test_deciles_follow_the_formula(spark):
    df = spark.createDataFrame([(f"{i:02}", float(i)) for i in range(13)], "id string, score double")
    got = {r.id: r.decile for r in measures.deciles(df).collect()}
    assert [got[f"{i:02}"] for i in range(13)] == [1, 1, 2, 3, 4, 4, 5, 6, 7, 7, 8, 9, 10]
    assert measures.deciles(df.limit(0)).count() == 0


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (None, 0.3)], "y int, p double")
    assert measures.ranked_auc(df, F.col("y"), F.col("p")).first()[0] == pytest.approx(0.875)
    assert measures.ranked_auc(df.where("y = 1"), F.col("y"), F.col("p")).first()[0] is None


def test_diverse_walk(spark):
    rng = random.Random(5)
    for _ in range(6):
        rows = [(f"{i:03}", f"a{rng.randrange(4)}", round(rng.random(), 3), rng.choice([None, "x>y", "p>q"])) for i in range(30)]
        picked, artists, reasons = [], {}, {}
        for r in sorted(rows, key=lambda r: (-r[2], r[0])):
            if len(picked) < 12 and artists.get(r[1], 0) < 2 and (r[3] is None or reasons.get(r[3], 0) < 3):
                picked.append(r[0])
                artists[r[1]] = artists.get(r[1], 0) + 1
                reasons[r[3]] = reasons.get(r[3], 0) + 1
        df = spark.createDataFrame(rows, "id string, artist string, score double, reason string")
        got = affinity.diverse(df, limit=12).orderBy("pos")
        assert [r.id for r in got.collect()] == picked


def test_retention_walk(spark):
    rng = random.Random(3)
    now = datetime(2024, 3, 1, 12)
    stamps = [now - timedelta(seconds=rng.randrange(120 * 86400)) for _ in range(300)]
    keep = {max(stamps)}
    form = {"hour": "%Y%m%d%H", "day": "%Y%m%d", "week": "%G-%V", "month": "%Y%m"}
    for window, kind in journal.TIERS:
        best = {}
        for s in stamps:
            if window is None or (now - s).total_seconds() <= window:
                if kind is None:
                    keep.add(s)
                else:
                    b = s.strftime(form[kind])
                    best[b] = max(best.get(b, s), s)
        keep |= set(best.values())
    df = spark.createDataFrame([(s,) for s in stamps] + [(None,)], "stamp timestamp_ntz")
    got = journal.keep(df, F.lit("2024-03-01 12:00:00").cast("timestamp"))
    assert {r.stamp for r in got.collect()} == keep


LOG = "seq long, op string, track string, tag string, playlist string, value string, before string"


def test_compaction_carries_the_first_baseline(spark):
    rows = [
        (1, "set_comment", "t", None, None, "a", "old"), (2, "set_comment", "t", None, None, "b", "a"), (3, "add_tag", "t", "x", None, None, None), (4, "remove_tag", "t", "x", None, None, None), (5, "odd", "t", None, None, None, None), (6, "set_color", None, None, None, "v", None),
        (7, "playlist_add", "t", None, "p1", None, None), (8, "playlist_add", "t", None, "p2", None, None), (9, "playlist_remove", "t", None, "p2", None, None), (10, "set_title", "t", None, None, "n", None), (11, "set_title", "t", None, None, "m", "q"), (12, "set_title", "t", None, None, "k", "n"), (13, "set_artwork", "t", None, None, "f", None),
    ]
    got = journal.compact(spark.createDataFrame(rows, LOG))
    assert {(r.field, r.op, r.value, r.before) for r in got.collect()} == {("comment", "set_comment", "b", "old"), ("tag:x", "remove_tag", None, None), ("list:p1", "playlist_add", None, None), ("list:p2", "playlist_remove", None, None), ("title", "set_title", "k", "q"), ("artwork", "set_artwork", "f", None)}


def test_baseline(spark):
    rows = [("set_color", " Red", "red ", True), ("set_rating", None, "0", True), ("set_genre", "a / b", "a/b", True), ("set_genre", "a,b", "a/b", False), ("set_artist", "x ", "x", True), ("set_title", "x ", "x", False), ("set_comment", None, "", True)]
    df = spark.createDataFrame(rows, "f string, c string, b string, ok boolean")
    assert df.where(journal.baseline_holds(F.col("f"), F.col("c"), F.col("b")) != F.col("ok")).count() == 0


def test_browse_rows(spark):
    view = spark.createDataFrame([("1", "T", None, ["a", "b"], 3, None, " red", ["x", "y", None]), ("2", None, "A", None, None, "c", None, None)], "id string, title string, artist string, genres array<string>, rating int, comment string, color string, tags array<string>")
    log = spark.createDataFrame([(1, "set_title", "1", None, None, "New", "T"), (2, "add_tag", "1", "a", None, None, None), (3, "remove_tag", "1", "y", None, None, None), (4, "set_color", "1", None, None, None, "red")], LOG)
    got = {r.id: r for r in journal.browse_rows(view, journal.compact(log)).collect()}
    assert (got["1"].title, got["1"].genre, got["1"].rating, got["1"].color, got["1"].tags, got["1"].base.title) == ("New", "a/b", "3", None, ["a", "x"], "T")
    assert (got["2"].title, got["2"].artist, got["2"].tags) == ("", "A", [])


def test_membership_and_links(spark):
    lists = spark.createDataFrame([("p1",), ("p2",)], "playlist string")
    entries = spark.createDataFrame([("p1", "t"), ("p1", "u")], "playlist string, track string")
    log = spark.createDataFrame([(1, "playlist_remove", "t", None, "p1", None, None), (2, "playlist_add", "t", None, "p2", None, None), (3, "playlist_add", "t", None, "p9", None, None)], LOG)
    assert {tuple(r) for r in journal.membership(lists, entries, journal.compact(log)).collect()} == {("t", "p1", False), ("t", "p2", True)}
    links = spark.createDataFrame([("a", "p1"), ("b", "new:x"), ("c", "p7")], "link string, playlist string")
    names = spark.createDataFrame([("p1", "One")], "playlist string, name string")
    assert {tuple(r) for r in journal.link_states(links, names).collect()} == {("a", "One", False, False), ("b", "", True, False), ("c", "", False, True)}
    assert not journal.link_states(links, names.limit(0)).where("gone").count()


def test_budget_keeps_two(spark):
    df = spark.createDataFrame([(i, i, 10.0) for i in range(5)], "id int, stamp int, bytes double")
    assert {r.id for r in journal.within_budget(df, 5.0).where("kept").collect()} == {4, 3}
    assert journal.within_budget(df, 0).where("kept").count() == 5


def test_waveform_and_runs(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 1.0, 4.0]), (2, []), (3, [0.0, 0.0]), (4, [9.0, 0.0, 0.0, 9.0, 0.0, 0.0])], "id int, v array<double>")
    got = {r.id: r for r in df.select("id", measures.waveform(F.col("v")).alias("w"), measures.quiet_runs(F.col("v"), F.lit(0.5), 2).alias("q")).collect()}
    assert got[1].w.dens == 0.25 and got[2].w is None and got[3].w is None
    assert (got[1].q, got[4].q) == (1, 1)


def test_collapse(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a", "a"],)], "v array<string>")
    assert df.select(measures.collapse(F.col("v"))).first()[0] == ["a", "b", "a"]


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "f"), ("c", "g"), ("g", "h"), ("h", "i")], "a string, b string")
    got = {r.node: r.comp for r in graph.components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "g": "a", "h": "a", "i": "a", "d": "d", "e": "d", "f": "f"}
    assert graph.components(edges.limit(0)).count() == 0


def sim(spark, ta, aa, tb, ab):
    left = matching.prepared(spark.createDataFrame([(1, ta, aa)], "k int, t string, a string"), "t", "a").select("k", *[F.col(c).alias(f"a_{c}") for c in ("base", "who", "base_words", "who_words")])
    right = matching.prepared(spark.createDataFrame([(1, tb, ab)], "k int, t string, a string"), "t", "a").select("k", *[F.col(c).alias(f"b_{c}") for c in ("base", "who", "base_words", "who_words")])
    return left.join(right, "k").select(matching.similarity("a_", "b_")).first()[0]


@pytest.mark.parametrize("ta, aa, tb, ab, low, high", [
    ("Move Your Body", "Ownboss", "Move Your Body", "Cara Elizabeth", 0.45, 0.45),
    ("Rockstar", "Highlite", "Postman (Extended Mix)", "Highlite", 0.0, 0.45),
    ("Freak", "Someone", "Freaks", "Someone", 0.9, 1.0),
    ("Move It (Extended Mix)", "", "I Love It", "", 0.0, 0.45),
    ("Born Slippy", "", "Born Slippy .NUXX", "", 0.6, 1.0),
    ("Alone", "X Y", "Alone (Club Mix)", "X Y", 0.99, 1.0),
])
def test_similarity(spark, ta, aa, tb, ab, low, high):
    assert low <= sim(spark, ta, aa, tb, ab) <= high


def test_manual_pairs_win(spark):
    found = spark.createDataFrame([("a", "1", 0.9, True, "have")], "aid string, id string, score double, same_version boolean, verdict string")
    hand = spark.createDataFrame([("a", "2"), ("b", "3")], "aid string, id string")
    assert {tuple(r) for r in matching.with_manual_pairs(found, hand).collect()} == {("a", "2", "1", "paired"), ("b", "3", None, "paired")}


def test_genre_issues(spark):
    cloud = spark.createDataFrame([("Nu Disco", 5), ("Nu disco", 2), ("Reggaeton", 9), ("Reggeaton", 1), ("House", 7)], "name string, n long")
    assert {tuple(r) for r in matching.genre_issues(cloud).collect()} == {("Nu Disco", "Nu disco", "same"), ("Reggaeton", "Reggeaton", "typo")}


def test_near_tempo_is_complete(spark):
    rng = random.Random(1)
    pool = [(str(i), rng.choice([0.0, None, round(rng.uniform(60, 190), 1)])) for i in range(200)]
    asked = pool[::10]
    dist = lambda a, b: min(abs(a - b), abs(a - 2 * b), abs(a - b / 2)) / a
    want = {(i, j) for i, a in asked for j, b in pool if i != j and a and b and dist(a, b) <= 0.06}
    got = vocabulary.near_tempo(spark.createDataFrame(asked, "id string, bpm double"), spark.createDataFrame(pool, "other string, other_bpm double"), 0.06)
    assert {(r.id, r.other) for r in got.collect()} == want


def test_bands_and_devices_on_empty_tables(spark):
    track = spark.read.parquet("/root/testdata/sf0.001/track.parquet").limit(0)
    probe = spark.read.parquet("/root/testdata/sf0.001/probe.parquet").limit(0)
    assert quality.bands(track, probe).count() == 0
    assert quality.duplicate_groups(track, probe).count() == 0
    assert quality.verdicts(track, probe).count() == 0


def test_tree_paths_end_on_cycles(spark):
    nodes = spark.createDataFrame([("r", "Root", None), ("a", "A", "r"), ("b", "B", "a"), ("x", "X", "y"), ("y", "Y", "x")], "id string, name string, parent_id string")
    assert {(r.id, r.path) for r in library.tree_paths(nodes).collect()} == {("r", "Root"), ("a", "Root / A"), ("b", "Root / A / B")}


def test_matching_folds_compatibility_letters(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in "Broken River")
    library = spark.createDataFrame([("1", wide, "Ada Moon", ["House"]), ("2", "Oﬃce Fire", "Zeno", ["House"])], "id string, title string, artist string, genres array<string>")
    asked = spark.createDataFrame([("a", "Broken River", "Ada Moon"), ("b", "Office Fire", "Zeno")], "aid string, title string, artist string")
    assert {(r.aid, r.id, r.score) for r in matching.blocked_matches(asked, library).collect()} == {("a", "1", 1.0), ("b", "2", 1.0)}
    assert [(r.id, r.exact) for r in matching.search(library, "broken river").collect()] == [("1", True)]


def test_words_in_brackets_and_live_block(spark):
    library = spark.createDataFrame([("1", "Midnight (Quasar Remix)", None), ("2", "Live", None), ("3", "For", None)], "id string, title string, artist string")
    asked = spark.createDataFrame([("a", "Midnigth (Quasar Remix)", None), ("b", "Live", None), ("c", "For", None)], "aid string, title string, artist string")
    assert {(r.aid, r.id) for r in matching.blocked_matches(asked, library).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}


def test_tree_paths_of_any_depth(spark):
    chain = spark.createDataFrame([(str(i), f"N{i}", str(i - 1) if i else None) for i in range(150)] + [("o", "Orphan", "gone")], "id string, name string, parent_id string")
    got = {r.id: (r.path, r.depth) for r in library.tree_paths(chain).collect()}
    assert len(got) == 151 and got["149"] == (" / ".join(f"N{i}" for i in range(150)), 149) and got["o"] == ("Orphan", 0)
    assert library.tree_paths(chain.limit(0)).count() == 0


def test_next_in_order_wraps(spark):
    rows = [(f"{i:03}", "red" if i % 3 else "blue", i * 7 % 50) for i in range(60)] + [("x", "green", 1)]
    df = spark.createDataFrame(rows, "id string, color string, added int")
    got = {r.id: r.next for r in library.next_in_order(df, "color", [F.desc("added"), F.desc("id")]).collect()}
    for color in ("red", "blue", "green"):
        order = [r[0] for r in sorted((r for r in rows if r[1] == color), key=lambda r: (r[2], r[0]), reverse=True)]
        assert [got[i] for i in order] == order[1:] + order[:1]


def test_auc_over_many_scores(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.choice([round(rng.random(), 2), rng.random()])) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert measures.ranked_auc(spark.createDataFrame(rows, "y int, p double"), F.col("y"), F.col("p")).first()[0] == pytest.approx(want)


def test_diverse_walk_over_many_pages(spark):
    rows = [(f"{i:04}", f"a{i // 300}", 1.0 - i / 2000, "x>y" if i % 2 else None) for i in range(1500)]
    picked, artists, reasons = [], {}, 0
    for i, a, _, r in rows:
        if artists.get(a, 0) < 2 and (r is None or reasons < 3):
            picked.append(i)
            artists[a] = artists.get(a, 0) + 1
            reasons += r is not None
    got = affinity.diverse(spark.createDataFrame(rows, "id string, artist string, score double, reason string"), limit=12).orderBy("pos")
    assert [r.id for r in got.collect()] == picked[:12]


def test_same_recordings(spark):
    rng = random.Random(7)
    rows = [(f"{i:03}", rng.randrange(100, 160), f"k{i % 3}", "b", "") for i in range(60)]
    got = {r.id: (r.class_id, r.links) for r in quality.same_recordings(spark.createDataFrame(rows, "id string, rb_length int, k_artist string, k_base string, k_version string")).collect()}
    for i, length, key, *_ in rows:
        near = [r for r in rows if r[2] == key and r[0] != i and abs(r[1] - length) <= 3]
        assert (got[i][1] if i in got else 0) == len(near)
        assert all(got[r[0]][0] == got[i][0] for r in near)


def test_held_files(spark):
    library = spark.createDataFrame([("/m/a.mp3", 10, "d1", "Ada", "Sun", 200, "1"), ("/m/01 Moon.mp3", 20, None, "Bob", "Moonlight", 100, "2")], "path string, size long, digest string, artist string, title string, rb_length int, id string")
    rows = [("/x/copy.mp3", 10, "d1", "", "", 1.0), ("/x/b.mp3", 11, "d2", "Ada", "Sun", 202.5), ("/x/c.mp3", 11, "d2", "Ada", "Sun", 204.0), ("/x/01 moon.flac", 5, None, "", "Other", 99.0), ("/x/d.mp3", 5, None, "Ada", "Sun", None), ("/m/a.mp3", 10, "d1", "Ada", "Sun", 200.0)]
    files = spark.createDataFrame(rows, "path string, size long, digest string, artist string, title string, seconds double")
    assert {tuple(r) for r in quality.held_files(files, library).collect()} == {("/x/copy.mp3", "identical", "/m/a.mp3"), ("/x/b.mp3", "same", "/m/a.mp3"), ("/x/01 moon.flac", "same", "/m/01 Moon.mp3")}


def test_playlist_check(spark):
    library = spark.createDataFrame([("1", "Broken River", "Ada Moon"), ("2", "Late Light", "Zeno")], "id string, title string, artist string")
    songs = spark.createDataFrame([("a", "Broken River", "Ada Moon"), ("b", "Other Song", "Nobody Here"), ("c", "Lost One", "Bob"), ("d", "Late Light (Club Mix)", "Zeno")], "key string, title string, artist string")
    manual = spark.createDataFrame([("c", "2"), ("b", "99")], "key string, id string")
    vain = spark.createDataFrame([("nobody here\tother song",)], "song string")
    got = {r.key: (r.verdict, r.id, r.paired, r.unfindable) for r in matching.playlist_check(songs, library, manual, vain).collect()}
    assert got == {"a": ("have", "1", False, False), "b": ("missing", None, False, True), "c": ("have", "2", True, False), "d": ("other", "2", False, False)}


def test_suggestions_count_decided_tracks_only(spark):
    rows = [("ask", 120.0, ["House"], ["own"])] + [(f"n{i}", 121.0 if i % 2 else None, ["House"], ["peak", "own"] if i < 5 else ["todo"] if i < 7 else ["warm"] if i < 9 else None) for i in range(10)] + [("far", 170.0, ["House"], ["peak"]), ("other", 120.0, ["Folk"], ["peak"])]
    view = spark.createDataFrame(rows, "id string, bpm double, genres array<string>, tags array<string>")
    vocabulary_ = spark.createDataFrame([("peak",), ("own",), ("warm",)], "name string")
    got = vocabulary.suggest_tags(view.where("id = 'ask'"), view, vocabulary_)
    assert {tuple(r) for r in got.collect()} == {("ask", "peak", 5, 0.71)}


def test_lossy_files_over_320_have_no_band(spark):
    track = spark.createDataFrame([("1", "/a", 300), ("2", "/b", 300), ("3", "/c", 30)], "id string, path string, rb_length int")
    probe = spark.createDataFrame([("/a", True, 1, 300.0, 500_000, 44100, 16, False, "MP3"), ("/b", True, 1, 300.0, 320_000, 44100, 16, False, "MP3")], "path string, exists boolean, size long, duration double, bitrate int, rate int, depth int, lossless boolean, codec string")
    assert {tuple(r) for r in quality.bands(track, probe).collect()} == {("le320", 1), ("clips", 1), ("total", 2)}


def test_ranks_are_a_permutation(spark):
    df = spark.range(5000).selectExpr("id", "pmod(id * 7919, 997) AS v")
    got = measures.global_rank(df, [F.col("v"), F.col("id")], "i").orderBy("i").collect()
    assert [r.i for r in got] == list(range(5000)) and [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_ratio_bounds_never_lie(spark):
    import difflib

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(0, 14))) for _ in range(60)] + [None, "x" * 300 + "y"]
    rows = [(a, b, f) for a in texts[:20] + texts[-2:] for b in texts for f in (0.0, 0.62)]
    got = spark.createDataFrame(rows, "a string, b string, f double").withColumn("r", matching.ratio_from(F.col("a"), F.col("b"), F.col("f"))).collect()
    for r in got:
        true = difflib.SequenceMatcher(None, r.a, r.b).ratio() if r.a and r.b else 0.0
        assert r.r == pytest.approx(true) if true >= r.f else true <= r.r + 1e-12 and r.r < r.f
