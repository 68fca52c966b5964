"""Queries over scans and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlore.functions.music import normalize_key
from setlore.functions.text import SHOP_TEXT, duration_label, is_branding
from setlore.operators import library as op
from setlore.tables import load

READY = "VETTED"
DOMAIN = ("track", "track_view", "probe", "song_tag", "tag", "history", "song_history", "documents")


def track_scan(s: SparkSession, d: str) -> DataFrame:
    return op.track_scan(load(s, d, "track"), load(s, d, "song_tag"), load(s, d, "tag"))


def playlists_in_order(s: SparkSession, d: str) -> DataFrame:
    placed = op.renumber(op.playlist_entries(load(s, d, "track")))
    return placed


def tag_groups(s: SparkSession, d: str) -> DataFrame:
    """Each group with its tags in order, groups without tags included."""
    tag = load(s, d, "tag")
    groups = tag.where("attribute = 1").select(F.col("id").alias("parent_id"), F.col("name").alias("bank"), F.col("seq").alias("bank_seq"))
    kids = tag.where("attribute = 0").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("kids"))
    return groups.join(kids, "parent_id", "left").select("bank", "bank_seq", F.coalesce(F.array_join("kids.name", "|"), F.lit("")).alias("tags"))


def tree_paths(s: SparkSession, d: str) -> DataFrame:
    """Every node of the tag tree with its path and kind."""
    tag = load(s, d, "tag")
    kind = F.when(F.col("attribute") == 1, "folder").when(F.col("attribute") == 4, "smart").otherwise("list")
    return op.tree_paths(tag).join(tag.select("id", kind.alias("kind")), "id")


def _played(s: SparkSession, d: str) -> DataFrame:
    return op.sessions(load(s, d, "song_history"), load(s, d, "history"))


def session_transitions(s: SparkSession, d: str) -> DataFrame:
    return op.transitions(_played(s, d))


def last_seen(s: SparkSession, d: str) -> DataFrame:
    return op.last_played(_played(s, d))


def history_merge(s: SparkSession, d: str) -> DataFrame:
    """Transition counts of two sources added up (U06); sessions with and without a known day stand for the sources."""
    played = _played(s, d)
    both = op.transitions(played.where("day <> ''")).unionByName(op.transitions(played.where("day = ''")))
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def track_view_build(s: SparkSession, d: str) -> DataFrame:
    return op.view(load(s, d, "track")).withColumn("genres", F.array_join("genres", "|"))


def min_duration(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").where("coalesce(rb_length, 0) >= 60").select("id", "rb_length")


def skipped_tally(s: SparkSession, d: str) -> DataFrame:
    colour = F.trim(F.coalesce("color", F.lit("")))
    rest = load(s, d, "track").where("coalesce(rb_length, 0) >= 60").where(colour != READY)
    return op.tally(rest, F.when(colour == "", "(no colour)").otherwise(colour), "colour")


def colour_counts(s: SparkSession, d: str) -> DataFrame:
    """Tracks by colour, case and outer blanks ignored."""
    return op.tally(load(s, d, "track_view"), F.lower(F.trim(F.coalesce("color", F.lit("")))), "colour")


def local_split(s: SparkSession, d: str) -> DataFrame:
    return op.tally(load(s, d, "track"), F.col("path").rlike(r"^(/|[A-Za-z]:)"), "local")


def table_sizes(s: SparkSession, d: str) -> DataFrame:
    """Rows of every domain table."""
    return reduce(DataFrame.unionByName, [load(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in DOMAIN])


def unplayed(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").select("id").join(_played(s, d).select(F.col("content").alias("id")), "id", "left_anti")


def played_in_view(s: SparkSession, d: str) -> DataFrame:
    """Transitions both ends of which are in the view and at least a minute long."""
    ids = load(s, d, "track_view").where("coalesce(seconds, 0) >= 60").select("id")
    t = session_transitions(s, d)
    return t.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def cue_counts(s: SparkSession, d: str) -> DataFrame:
    """Tag rows by track, live ones only."""
    return load(s, d, "song_tag").where("deleted = 0").groupBy("content_id").agg(F.count("*").alias("n"))


def browse_newest(s: SparkSession, d: str) -> DataFrame:
    """The 60 newest tracks by (added, imported), ids breaking ties (O04: a page of the list)."""
    empty = F.lit("")
    return load(s, d, "track_view").select("id", F.coalesce("added", empty).alias("added"), F.coalesce("imported", empty).alias("imported")).orderBy(F.desc("added"), F.desc("imported"), "id").limit(60)


def triage_next(s: SparkSession, d: str) -> DataFrame:
    """For every track of a colour's queue, newest first, the next one; the last one wraps to the newest."""
    queue = load(s, d, "track_view").where("color is not null and color <> ''").select("color", "id", F.coalesce("added", F.lit("")).alias("added"))
    return op.next_in_order(queue, "color", [F.desc("added"), F.desc("id")]).select("color", "id", "next")


def durations(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").select("id", duration_label(F.col("rb_length")).alias("label"))


def branding(s: SparkSession, d: str) -> DataFrame:
    """Texts that hold a web address or a shop's name, by source (P10)."""
    docs = load(s, d, "documents").select(F.coalesce("source", F.lit("(none)")).alias("source"), is_branding(F.col("text")).alias("brand"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("brand").cast("long")).alias("branded"))


def access_buckets(s: SparkSession, d: str) -> DataFrame:
    """Files by state and place, with an example, missing ones first."""
    files = load(s, d, "track").select("path").where("path like '/%'").join(load(s, d, "probe").select("path", "exists").distinct(), "path", "left")
    state = F.when(F.col("exists"), "ok").when(F.col("exists").isNull(), "unknown").otherwise("missing")
    return files.groupBy(state.alias("state"), F.regexp_extract("path", r"^(/[^/]+/[^/-]+)", 1).alias("place")).agg(F.count("*").alias("n"), F.min("path").alias("example"))


def majority_flag(s: SparkSession, d: str) -> DataFrame:
    """The commonest sample rate of each format (A32); of ties the smaller."""
    counts = load(s, d, "track").where("rb_rate is not null").groupBy("ext", "rb_rate").agg(F.count("*").alias("n"))
    return counts.groupBy("ext").agg(F.min(F.struct((-F.col("n")).alias("n"), "rb_rate")).alias("m")).select("ext", F.col("m.rb_rate").alias("rate"), (-F.col("m.n")).alias("n"))


def star_scan(s: SparkSession, d: str) -> DataFrame:
    """Tracks with their key, genre, file and last play looked up; what is unknown stays null."""
    key = load(s, d, "key_ref").select(F.col("key_id"), F.explode(F.array("camelot", "scale_name")).alias("key")).groupBy("key").agg(F.min("key_id").alias("key_id"))
    genre = load(s, d, "genre_ref").select(F.col("name").alias("genre"), "genre_id", "family")
    last = op.last_played(_played(s, d)).withColumnRenamed("content", "id")
    files = load(s, d, "probe").groupBy("path").agg(F.max("codec").alias("codec"))
    return load(s, d, "track").select("id", "key", "genre", "path").join(key, "key", "left").join(genre, "genre", "left").join(files, "path", "left").join(last, "id", "left").select("id", "key_id", "genre_id", "family", "codec", "last")


def scan_stats(s: SparkSession, d: str) -> DataFrame:
    """All tracks, those with a file of their own, and streamed ones."""
    local = F.coalesce(F.col("path"), F.lit("")).rlike(r"^(/|[A-Za-z]:)").cast("long")
    return load(s, d, "track").agg(F.count("*").alias("total"), F.sum(local).alias("local"), F.sum(1 - local).alias("streaming"))


# Names of phrase kinds.
PHRASES = {1: "intro", 2: "up", 3: "down", 4: "bridge", 5: "chorus", 6: "outro", 7: "verse", 8: "verse", 9: "verse", 10: "outro"}


def phrase_names(s: SparkSession, d: str) -> DataFrame:
    """Line numbers of orders as kinds of phrases, by name; unknown kinds stay numbers."""
    kind = (F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 6).otherwise(0)).cast("int")
    names = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    return load(s, d, "lineitem").groupBy(F.coalesce(names[kind], kind.cast("string")).alias("name")).agg(F.count("*").alias("n"))


def defaults_overlay(s: SparkSession, d: str) -> DataFrame:
    """The caps of the sources as defaults under stored values, here the number of tags that their documents name; stored keys that are not known are dropped."""
    stored = load(s, d, "documents").groupBy(F.col("source").alias("name")).agg(F.nullif(F.countDistinct("tag_id"), F.lit(0)).alias("stored"))
    return load(s, d, "source_target").select(F.col("source").alias("name"), F.col("max_repeats").alias("default")).join(stored, "name", "left").select("name", F.coalesce("stored", "default").cast("long").alias("value"))


def overwrite_playlists(s: SparkSession, d: str) -> DataFrame:
    """Every session's plays as the new content of a playlist: the first place of each track that exists, numbered again; none for sessions of which nothing exists."""
    live = load(s, d, "track").where("rating > 0").select(F.col("id").alias("track"))
    wanted = _played(s, d).select(F.col("session").alias("playlist"), "trackno", F.col("content").alias("track")).join(live, "track", "left_semi")
    return op.renumber(wanted)


def native_flag(s: SparkSession, d: str) -> DataFrame:
    """The commonest bitrate of the newest 200 tracks whose lowest bit is free, 14 if there is none."""
    newest = load(s, d, "track").where("rb_bitrate is not null").select("rb_bitrate", F.coalesce("added", F.lit("")).alias("added"), "id").orderBy(F.desc("added"), F.desc("id")).limit(200)
    votes = newest.where(F.col("rb_bitrate").bitwiseAND(1) == 0).groupBy("rb_bitrate").agg(F.count("*").alias("n"))
    return votes.agg(F.min(F.struct((-F.col("n")).alias("n"), "rb_bitrate")).alias("m")).select(F.coalesce("m.rb_bitrate", F.lit(14)).alias("flag"))


def key_staleness(s: SparkSession, d: str) -> DataFrame:
    """Tracks to be analysed anew: not measured, or measured under another key than the view has, keys compared as keys."""
    rows = load(s, d, "track").select("id", "path", normalize_key(F.col("key")).alias("raw")).join(load(s, d, "track_view").select("id", F.coalesce("key", F.lit("")).alias("key")), "id").join(load(s, d, "probe").where("exists").select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    why = F.when(F.col("there").isNull(), "no file").when(F.col("raw") != F.col("key"), "other key")
    return rows.groupBy(F.coalesce(why, F.lit("fresh")).alias("state")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (star_scan, scan_stats, phrase_names, defaults_overlay, overwrite_playlists, native_flag, key_staleness, track_scan, playlists_in_order, tag_groups, tree_paths, session_transitions, last_seen, history_merge, track_view_build, min_duration, skipped_tally, colour_counts, local_split, table_sizes, unplayed, played_in_view, cue_counts, browse_newest, triage_next, durations, branding, access_buckets, majority_flag)}

TEMPO = "CASE WHEN bpm > 1000 THEN round(bpm / 100, 1) ELSE coalesce(bpm, 0) END"
FOLD = "regexp_replace(strip_accents(nfc_normalize(lower({}))), '\\p{{Mn}}', '', 'g')"
NOTE = r"'^(\d{1,2})\s*[-–—.:]?\s*(.*)$'"
COMMENT = r"regexp_replace(coalesce(comment, ''), '^\s+|\s+$', '', 'g')"
ENERGY = f"""CASE WHEN TRY_CAST(regexp_extract({COMMENT}, {NOTE}, 1, 's') AS INT) BETWEEN 1 AND 10 THEN TRY_CAST(regexp_extract({COMMENT}, {NOTE}, 1, 's') AS INT) END"""
GENRES = r"list_filter(list_transform(string_split_regex(coalesce(genre, ''), '[/,;|]'), lambda g: regexp_replace(g, '^\s+|\s+$', '', 'g')), lambda g: g <> '')"
KEY_SQL = r"""
    CASE WHEN s IN ('', 'ALL') THEN ''
    WHEN regexp_matches(s, '^0?(\d{1,2})([ABM])?$') THEN
        CASE WHEN regexp_extract(s, '^0?(\d{1,2})([ABM])?$', 1)::INT BETWEEN 1 AND 12 THEN regexp_extract(s, '^0?(\d{1,2})([ABM])?$', 1)::INT ||
            CASE regexp_extract(s, '^0?(\d{1,2})([ABM])?$', 2) WHEN 'M' THEN CASE WHEN ends_with(tr, 'M') THEN 'B' ELSE 'A' END WHEN '' THEN 'A' ELSE regexp_extract(s, '^0?(\d{1,2})([ABM])?$', 2) END ELSE '' END
    ELSE coalesce(CASE WHEN regexp_extract(s, '^[A-G][#B]?(.*)$', 1) LIKE 'MIN%' OR regexp_extract(s, '^[A-G][#B]?(.*)$', 1) = 'M'
            THEN map {'AB':'1A','G#':'1A','EB':'2A','D#':'2A','BB':'3A','A#':'3A','F':'4A','C':'5A','G':'6A','D':'7A','A':'8A','E':'9A','B':'10A','F#':'11A','GB':'11A','DB':'12A','C#':'12A'}[regexp_extract(s, '^([A-G][#B]?)', 1)]
        WHEN regexp_extract(s, '^[A-G][#B]?(.*)$', 1) LIKE 'MAJ%' OR regexp_matches(s, '^[A-G][#B]?$')
            THEN map {'B':'1B','F#':'2B','GB':'2B','DB':'3B','C#':'3B','AB':'4B','G#':'4B','EB':'5B','D#':'5B','BB':'6B','A#':'6B','F':'7B','C':'8B','G':'9B','D':'10B','A':'11B','E':'12B'}[regexp_extract(s, '^([A-G][#B]?)', 1)] END, '') END"""
KEYED = r"(SELECT *, replace(upper(tr), ' ', '') AS s FROM (SELECT *, regexp_replace(coalesce(key, ''), '^\s+|\s+$', '', 'g') AS tr FROM track))"
LIVE_TAGS = """(SELECT DISTINCT st.content_id, st.tag_id, t.name, g.name AS cat, coalesce(g.seq, 99) AS catseq FROM song_tag st JOIN tag t ON t.id = st.tag_id AND t.attribute = 0 LEFT JOIN tag g ON g.id = t.parent_id WHERE st.deleted = 0)"""
PLAYED = """(SELECT s.history_id AS session, coalesce(left(h.date_created, 10), '') AS day, coalesce(s.track_no, 0) AS trackno, s.content_id AS content
    FROM song_history s JOIN history h ON h.id = s.history_id WHERE s.deleted = 0 AND h.deleted = 0 AND s.content_id IS NOT NULL)"""
TRANSITIONS = f"""(SELECT src, dst, count(*) AS n FROM (SELECT content AS src, lead(content) OVER (PARTITION BY session ORDER BY trackno, content) AS dst FROM {PLAYED}) WHERE src <> dst GROUP BY ALL)"""

ORACLES = {
    "track_scan": f"""WITH tags AS (SELECT content_id, string_agg(name, '|' ORDER BY catseq, name) AS tags FROM {LIVE_TAGS} GROUP BY 1)
        SELECT id, CASE WHEN trim(coalesce(title, '')) = '' THEN regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) ELSE trim(title) END AS title, coalesce(rb_length, 0) AS seconds, coalesce(rb_bitrate, 0) AS kbps, coalesce(rating, 0) AS rating, {TEMPO} AS bpm, tags
        FROM track LEFT JOIN tags ON content_id = id WHERE regexp_matches(path, '^(/|[A-Za-z]:)')""",
    "playlists_in_order": """SELECT playlist, row_number() OVER (PARTITION BY playlist ORDER BY place, track) AS pos, track FROM (
        SELECT p.id AS playlist, id AS track, min(coalesce(p.trackno, 0)) AS place FROM (SELECT id, unnest(playlists) AS p FROM track) GROUP BY ALL)""",
    "tag_groups": """SELECT g.name AS bank, g.seq AS bank_seq, coalesce(string_agg(t.name, '|' ORDER BY t.seq, t.name), '') AS tags FROM tag g LEFT JOIN tag t ON t.parent_id = g.id AND t.attribute = 0 WHERE g.attribute = 1 GROUP BY g.id, g.name, g.seq""",
    "tree_paths": """WITH RECURSIVE walk AS (SELECT id, name AS path, 0 AS depth FROM tag WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM tag) UNION ALL SELECT n.id, w.path || ' / ' || n.name, w.depth + 1 FROM tag n JOIN walk w ON n.parent_id = w.id)
        SELECT id, path, depth, CASE attribute WHEN 1 THEN 'folder' WHEN 4 THEN 'smart' ELSE 'list' END AS kind FROM walk JOIN tag USING (id)""",
    "session_transitions": f"SELECT * FROM {TRANSITIONS}",
    "last_seen": f"SELECT content, max(day) AS last FROM {PLAYED} WHERE day <> '' GROUP BY 1",
    "history_merge": f"SELECT * FROM {TRANSITIONS}",
    "track_view_build": f"""SELECT id, {TEMPO} AS bpm, {KEY_SQL} AS key, array_to_string({GENRES}, '|') AS genres, {ENERGY} AS energy,
        CASE WHEN {ENERGY} IS NULL THEN {COMMENT} ELSE regexp_replace(regexp_extract({COMMENT}, {NOTE}, 2, 's'), '\\s+$', '', 'g') END AS note, coalesce(rb_bitrate, 0) AS kbps,
        {FOLD.format("coalesce(artist, '') || ' ' || coalesce(title, '') || ' ' || coalesce(genre, '') || ' ' || coalesce(comment, '') || ' ' || coalesce(key, '')")} AS search FROM {KEYED}""",
    "min_duration": "SELECT id, rb_length FROM track WHERE coalesce(rb_length, 0) >= 60",
    "skipped_tally": "SELECT CASE WHEN trim(coalesce(color, '')) = '' THEN '(no colour)' ELSE trim(color) END AS colour, count(*) AS n FROM track WHERE coalesce(rb_length, 0) >= 60 AND trim(coalesce(color, '')) <> 'VETTED' GROUP BY 1",
    "colour_counts": "SELECT lower(trim(coalesce(color, ''))) AS colour, count(*) AS n FROM track_view GROUP BY 1",
    "local_split": "SELECT regexp_matches(path, '^(/|[A-Za-z]:)') AS local, count(*) AS n FROM track GROUP BY 1",
    "table_sizes": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in DOMAIN),
    "unplayed": f"SELECT id FROM track WHERE id NOT IN (SELECT content FROM {PLAYED})",
    "played_in_view": f"SELECT src, dst, n FROM {TRANSITIONS} WHERE src IN (SELECT id FROM track_view WHERE coalesce(seconds, 0) >= 60) AND dst IN (SELECT id FROM track_view WHERE coalesce(seconds, 0) >= 60)",
    "cue_counts": "SELECT content_id, count(*) AS n FROM song_tag WHERE deleted = 0 GROUP BY 1",
    "browse_newest": "SELECT id, coalesce(added, '') AS added, coalesce(imported, '') AS imported FROM track_view ORDER BY 2 DESC, 3 DESC, id LIMIT 60",
    "triage_next": "SELECT color, id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS next FROM (SELECT color, id, coalesce(added, '') AS added FROM track_view WHERE color <> '') WINDOW w AS (PARTITION BY color ORDER BY added DESC, id DESC)",
    "durations": "SELECT id, CASE WHEN coalesce(rb_length, 0) = 0 THEN '—' ELSE (rb_length // 60)::VARCHAR || ':' || lpad((rb_length % 60)::VARCHAR, 2, '0') END AS label FROM track",
    "branding": r"""SELECT coalesce(source, '(none)') AS source, count(*) AS n, sum((regexp_matches(coalesce(text, ''), '(?i)\b(?:https?://|www\.)|\b[a-z0-9-]+\.(?:com|net|org|io|co)\b') OR regexp_matches(coalesce(text, ''), 'SHOPS'))::INT)::BIGINT AS branded FROM documents GROUP BY 1""".replace("SHOPS", SHOP_TEXT),
    "access_buckets": """SELECT CASE WHEN p."exists" THEN 'ok' WHEN p."exists" IS NULL THEN 'unknown' ELSE 'missing' END AS state, regexp_extract(t.path, '^(/[^/]+/[^/-]+)', 1) AS place, count(*) AS n, min(t.path) AS example
        FROM track t LEFT JOIN (SELECT DISTINCT path, "exists" FROM probe) p ON p.path = t.path WHERE t.path LIKE '/%' GROUP BY 1, 2""",
    "majority_flag": "SELECT ext, rb_rate AS rate, count(*) AS n FROM track WHERE rb_rate IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ext ORDER BY count(*) DESC, rb_rate) = 1",
    "star_scan": f"""SELECT t.id, k.key_id, g.genre_id, g.family, p.codec, l.last FROM track t LEFT JOIN (SELECT key, min(key_id) AS key_id FROM (SELECT key_id, unnest([camelot, scale_name]) AS key FROM key_ref) GROUP BY 1) k ON k.key = t.key LEFT JOIN genre_ref g ON g.name = t.genre
        LEFT JOIN (SELECT path, max(codec) AS codec FROM probe GROUP BY 1) p ON p.path = t.path LEFT JOIN (SELECT content, max(day) AS last FROM {PLAYED} WHERE day <> '' GROUP BY 1) l ON l.content = t.id""",
    "scan_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE regexp_matches(coalesce(path, ''), '^(/|[A-Za-z]:)')) AS local, count(*) FILTER (WHERE NOT regexp_matches(coalesce(path, ''), '^(/|[A-Za-z]:)')) AS streaming FROM track",
    "phrase_names": "SELECT CASE WHEN k = 1 THEN 'intro' WHEN k = 2 THEN 'up' WHEN k = 3 THEN 'down' WHEN k = 4 THEN 'bridge' WHEN k = 5 THEN 'chorus' WHEN k IN (6, 10) THEN 'outro' WHEN k IN (7, 8, 9) THEN 'verse' ELSE k::VARCHAR END AS name, count(*) AS n FROM (SELECT l_linenumber + CASE WHEN l_returnflag = 'R' THEN 6 ELSE 0 END AS k FROM lineitem) GROUP BY 1",
    "defaults_overlay": "SELECT s.source AS name, coalesce(nullif((SELECT count(DISTINCT tag_id) FROM documents d WHERE d.source = s.source), 0), max_repeats)::BIGINT AS value FROM source_target s",
    "overwrite_playlists": f"""SELECT playlist, row_number() OVER (PARTITION BY playlist ORDER BY place, track) AS pos, track FROM (SELECT session AS playlist, content AS track, min(trackno) AS place FROM {PLAYED} WHERE content IN (SELECT id FROM track WHERE rating > 0) GROUP BY ALL)""",
    "native_flag": "WITH n AS (SELECT rb_bitrate FROM track WHERE rb_bitrate IS NOT NULL ORDER BY coalesce(added, '') DESC, id DESC LIMIT 200) SELECT coalesce((SELECT rb_bitrate FROM n WHERE rb_bitrate & 1 = 0 GROUP BY 1 ORDER BY count(*) DESC, rb_bitrate LIMIT 1), 14) AS flag",
    "key_staleness": f"""SELECT CASE WHEN p.path IS NULL THEN 'no file' WHEN r.raw <> coalesce(v.key, '') THEN 'other key' ELSE 'fresh' END AS state, count(*) AS n FROM (SELECT id, path, {KEY_SQL} AS raw FROM {KEYED}) r JOIN track_view v USING (id) LEFT JOIN (SELECT DISTINCT path FROM probe WHERE "exists") p ON p.path = r.path GROUP BY 1""",
}
