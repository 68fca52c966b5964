"""Queries over measured quality, duplicates, players and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setlore.functions.text import COMPILATION, NO_VERSION, VERSION_HINT, is_compilation, quality_label, work_label
from setlore.operators import quality as op
from setlore.plans.library import FOLD
from setlore.session import materialise
from setlore.tables import load


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(s, d, "track"), load(s, d, "probe")


def probe_bitrate(s: SparkSession, d: str) -> DataFrame:
    return op.probes(load(s, d, "probe")).select("path", "bitrate", "lossless")


def dupe_groups(s: SparkSession, d: str) -> DataFrame:
    return op.duplicate_groups(*_both(s, d)).select("k_artist", "k_base", "k_version", "n", "spread", "tied", "verdict")


def dupe_best_copy(s: SparkSession, d: str) -> DataFrame:
    return op.duplicate_groups(*_both(s, d)).select("k_artist", "k_base", "k_version", "best")


def dupe_lost_tags(s: SparkSession, d: str) -> DataFrame:
    return op.lost_tags(load(s, d, "track"), op.duplicate_groups(*_both(s, d)))


def dupe_merge_plan(s: SparkSession, d: str) -> DataFrame:
    return op.merge_plan(load(s, d, "track"), op.duplicate_groups(*_both(s, d)))


def work_score(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").select("id", op.work_score(F.col("mytags"), F.col("cues"), F.col("playlists"), F.col("comment"), F.col("rating")).cast("int").alias("work"))


def device_compat(s: SparkSession, d: str) -> DataFrame:
    v = op.verdicts(*_both(s, d)).groupBy("device").agg(F.count("*").alias("total"), F.count("why").alias("bad"), F.count("why_low").alias("bad_low"))
    pct = lambda bad: F.round((F.col("total") - bad) / F.col("total") * 100, 1)
    return v.select("device", "total", "bad", pct(F.col("bad")).alias("pct"), pct(F.col("bad_low")).alias("pct_low"))


def device_reasons(s: SparkSession, d: str) -> DataFrame:
    return op.verdicts(*_both(s, d)).where("why is not null").groupBy("device", "why").agg(F.count("*").alias("n"))


def quality_bands(s: SparkSession, d: str) -> DataFrame:
    return op.bands(*_both(s, d))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Files with their status: used if they have the top rating, dupe if another copy exists, else unique."""
    track, probe = _both(s, d)
    copies = op.keyed(track).groupBy(*op.KEY).agg(F.count("*").alias("copies"))
    held = op.keyed(track).select("id", *op.KEY).join(copies, list(op.KEY)).select("id", "copies")
    status = F.when(F.col("rating") == 5, "used").when(F.col("copies") > 1, "dupe").otherwise("unique")
    return track.select("id", "path", "rating").join(held, "id", "left").join(op.probes(probe).select("path", "size"), "path", "left").select("path", "size", status.alias("status"))


def folder_rollup(s: SparkSession, d: str) -> DataFrame:
    return op.folder_rollup(_files(s, d))


def topmost_folders(s: SparkSession, d: str) -> DataFrame:
    return op.topmost(op.folder_rollup(_files(s, d)), share=0.05).select("folder", "audio", "dupes")


def missing_and_orphans(s: SparkSession, d: str) -> DataFrame:
    """Paths that only the library or only the disk knows, by extension."""
    refs = load(s, d, "track").where("path like '/%'").select("path").distinct()
    disk = load(s, d, "probe").where("exists").select("path").distinct()
    both = refs.join(disk, "path", "left_anti").withColumn("side", F.lit("missing")).unionByName(disk.join(refs, "path", "left_anti").withColumn("side", F.lit("orphan")))
    return both.groupBy("side", F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext")).agg(F.count("*").alias("n"))


def storage_report(s: SparkSession, d: str) -> DataFrame:
    sized = op.probes(load(s, d, "probe")).groupBy(F.coalesce("codec", F.lit("(none)")).alias("item")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
    return sized.unionByName(sized.agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files")).withColumn("item", F.lit("total")))


def format_histogram(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").groupBy("ext", F.coalesce("rb_depth", F.lit(0)).alias("depth")).agg(F.count("*").alias("n"), F.sum(F.coalesce("rb_size", F.lit(0))).alias("bytes"))


def same_recording(s: SparkSession, d: str) -> DataFrame:
    """Tracks under one duplicate key that a chain of lengths within three seconds joins, with their class and number of links."""
    return op.same_recordings(op.keyed(load(s, d, "track")).where("coalesce(rb_length, 0) > 0").select("id", "rb_length", *op.KEY))


def merged_sets(s: SparkSession, d: str) -> DataFrame:
    """The tags and playlists that the best copy of each group would gain."""
    return op.merge_sets(load(s, d, "track"), op.duplicate_groups(*_both(s, d)))


def dupe_order(s: SparkSession, d: str) -> DataFrame:
    """The first 200 groups in the order of a list, without those marked as no duplicates, here all of two copies that are to be reviewed."""
    groups = materialise(op.duplicate_groups(*_both(s, d)))
    return op.ordered_groups(groups, groups.where("verdict = 'review' and n = 2").select(*op.KEY))


def held_files(s: SparkSession, d: str) -> DataFrame:
    """Measured files beside a library of the tracks with five stars: identical and same recordings (J06, J07, M06). Size and length stand for the samples of the content."""
    track, probe = _both(s, d)
    sized = op.probes(probe).where("exists").select("path", "size", "duration", F.md5(F.concat_ws("|", "size", "duration")).alias("digest"))
    rows = track.select("id", "path", "artist", "title", "rb_length", "rating").join(sized, "path")
    return op.held_files(rows.withColumn("seconds", F.col("duration")), rows.where("rating = 5"))


def folder_order(s: SparkSession, d: str) -> DataFrame:
    """The first 200 folders by bytes of duplicates."""
    best = op.folder_rollup(_files(s, d)).where("dupes > 0").orderBy(F.desc("dupe_bytes"), "folder").limit(200)
    return best.select(F.row_number().over(Window.orderBy(F.desc("dupe_bytes"), "folder")).alias("pos"), "folder", "dupes", "dupe_bytes")


def space_check(s: SparkSession, d: str) -> DataFrame:
    """What a conversion would take, with 20 GB free."""
    return op.space_check(*_both(s, d), free=20e9)


def format_issues(s: SparkSession, d: str) -> DataFrame:
    """What even the best player refuses, FLAC under one name, with 60 sample files each."""
    v = op.verdicts(*_both(s, d)).where("device = 'nxs2'").join(load(s, d, "track").select("id", "path", "ext"), "id")
    why = F.when(F.col("ext") == ".flac", "FLAC").otherwise(F.col("why"))
    w = Window.partitionBy("why").orderBy("path")
    rows = v.select(why.alias("why"), "path").where("why is not null")
    sample = rows.withColumn("r", F.row_number().over(w)).where("r <= 60").groupBy("why").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("files"))
    return rows.groupBy("why").agg(F.count("*").alias("n")).join(sample, "why")


def paths_found(s: SparkSession, d: str) -> DataFrame:
    """The track at each measured path, case ignored, rated ones standing for live rows."""
    wanted = load(s, d, "probe").select(F.upper("path").alias("path")).distinct()
    return op.paths_found(wanted, load(s, d, "track").select("path", "id", (F.coalesce("rating", F.lit(0)) > 0).alias("live")))


def file_identities(s: SparkSession, d: str) -> DataFrame:
    """Files by what identifies them, with how many rows have it; size and rate stand for device and inode."""
    rows = load(s, d, "probe").where("path is not null").select("path", F.nullif("size", F.lit(0)).alias("dev"), F.col("rate").alias("ino")).distinct()
    return op.file_identity(rows).groupBy("identity").agg(F.count("*").alias("n"), F.min("path").alias("path"))


def missing_artwork(s: SparkSession, d: str) -> DataFrame:
    """Tracks without a colour standing for those without artwork, their tags for candidates."""
    tag = load(s, d, "tag").select(F.col("id").alias("tag_id"), "seq", "name")
    found = load(s, d, "song_tag").join(tag, "tag_id").select(F.col("content_id").alias("id"), F.col("tag_id").alias("url"), F.round(F.col("seq") / 10.0, 2).alias("score"), is_compilation(F.col("name"), F.lit("")).alias("compilation"), (F.col("deleted") == 0).alias("same_version"))
    queued = load(s, d, "track").where("rating = 5").select("id")
    return op.missing_artwork(load(s, d, "track").select("id", F.col("color").alias("image")), found, queued)


def copy_labels(s: SparkSession, d: str) -> DataFrame:
    """Quality and work of every track in words."""
    rows = op.measured(load(s, d, "track"), load(s, d, "probe"))
    return rows.select("id", quality_label(F.col("exists"), F.col("codec"), F.col("lossless"), F.col("rate"), F.col("depth"), F.col("bitrate")).alias("quality"), work_label(F.col("mytags"), F.col("cues"), F.col("comment"), F.col("rating")).alias("work"))


QUERIES = {f.__name__: f for f in (probe_bitrate, dupe_groups, dupe_best_copy, dupe_lost_tags, dupe_merge_plan, work_score, device_compat, device_reasons, quality_bands, folder_rollup, topmost_folders, missing_and_orphans, storage_report, format_histogram, same_recording, merged_sets, dupe_order, held_files, folder_order, space_check, format_issues, paths_found, file_identities, missing_artwork, copy_labels)}

NORM = "trim(regexp_replace(regexp_replace(" + FOLD + r", '[&+]', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
HINT, NONE = f"'{VERSION_HINT}'", f"'{NO_VERSION}'"
KEYED = f"""keyed AS (SELECT *, {NORM.format("string_split_regex(regexp_replace(coalesce(artist, ''), '[&+]', ' and ', 'g'), '\\s*[,;/]\\s*|\\s+(?:and|vs|x)\\s+')[1]")} AS k_artist,
        {NORM.format(r"regexp_replace(regexp_replace(coalesce(title, ''), '[(\[][^)\]]*[)\]]', ' ', 'g'), '(?i)\b(feat|ft|featuring)\.?\s+[^()\[\]-]+', ' ', 'g')")} AS k_base,
        array_to_string(list_sort(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(coalesce(title, ''), '[(\\[]([^)\\]]*)[)\\]]', 1), lambda x: trim(x)), lambda x: regexp_matches(x, {HINT}) AND NOT regexp_matches(x, {NONE})), lambda x: {NORM.format("x")}), lambda x: x <> '')), ' ') AS k_version FROM track)"""
FILE = 'file AS (SELECT DISTINCT path, "exists", size, duration, coalesce(bitrate, floor(size * 8.0 / nullif(duration, 0))::INT) AS bitrate, rate, depth, coalesce(lossless, false) AS lossless, codec FROM probe WHERE path IS NOT NULL)'
WORK = "len(coalesce(mytags, [])) * 2 + coalesce(cues, 0) * 2 + len(coalesce(playlists, [])) * 3 + CASE WHEN coalesce(comment, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(rating, 0) <> 0 THEN 1 ELSE 0 END"
GROUPS = f"""WITH {KEYED}, {FILE},
    copy AS (SELECT k.id, k_artist, k_base, k_version, coalesce(nullif(duration, 0), nullif(rb_length, 0)) AS seconds, coalesce(lossless, false)::INT AS ll,
        CASE WHEN coalesce(lossless, false) THEN coalesce(nullif(depth, 0), 16)::BIGINT * coalesce(nullif(rate, 0), 44100) ELSE coalesce(bitrate, 0) END AS amount, coalesce(size, 0) AS fsize,
        lower(ext) IN ('.mp3', '.m4a', '.mp4', '.wav', '.aiff', '.aif') AND NOT (lower(ext) IN ('.m4a', '.mp4') AND coalesce(codec = 'ALAC', false)) AS plays, coalesce(cues, 0) AS cues, {WORK} AS work, mytags, playlists, coalesce(rating, 0) AS rating
        FROM keyed k LEFT JOIN file f ON f.path = k.path WHERE k_base <> ''),
    ranked AS (SELECT *, count(*) OVER g AS n, min(ll * 1e12 + amount) OVER g = max(ll * 1e12 + amount) OVER g AS tied, min(fsize) OVER g = max(fsize) OVER g AS same_size, max(seconds) OVER g AS long, min(seconds) OVER g AS short, count(seconds) OVER g AS timed,
        row_number() OVER (g ORDER BY ll DESC, amount DESC, fsize DESC, id DESC) AS q, row_number() OVER (g ORDER BY work DESC, ll DESC, amount DESC, fsize DESC, id DESC) AS w, max(work) OVER g AS most,
        row_number() OVER (g ORDER BY plays DESC, ll DESC, amount DESC, fsize DESC, id DESC) AS e FROM copy WINDOW g AS (PARTITION BY k_artist, k_base, k_version)),
    first AS (SELECT k_artist, k_base, k_version, any_value(n) AS n, any_value(tied) AS tied, any_value(same_size) AS same_size, max(long) AS long, min(short) AS short, any_value(timed) AS timed, max(CASE WHEN (CASE WHEN tied AND most > 0 THEN w ELSE q END) = 1 THEN id END) AS best0,
        bool_or((CASE WHEN tied AND most > 0 THEN w ELSE q END) = 1 AND NOT plays AND cues = 0 AND tied) AS swap, max(CASE WHEN e = 1 AND plays THEN id END) AS everywhere FROM ranked WHERE n > 1 GROUP BY 1, 2, 3),
    groups AS (SELECT *, CASE WHEN timed > 1 THEN long - short ELSE 0.0 END AS apart, CASE WHEN swap AND everywhere IS NOT NULL THEN everywhere ELSE best0 END AS best FROM first)"""
CODEC = "(SELECT path, max(codec) AS codec FROM probe GROUP BY path)"
DEVICE_ROWS = """(SELECT * FROM (VALUES ('nxs2', ['.mp3','.m4a','.mp4','.wav','.aiff','.aif','.flac'], true, 24, 24), ('nxs', ['.mp3','.m4a','.mp4','.wav','.aiff','.aif'], false, 24, 24), ('entry', ['.mp3','.m4a','.mp4','.wav','.aiff','.aif'], false, 24, 16)) AS d(device, formats, alac, bits, low))"""
WHY = "CASE WHEN NOT list_contains(formats, lower(ext)) THEN upper(ltrim(lower(ext), '.')) || ' format' WHEN lower(ext) IN ('.m4a', '.mp4') AND coalesce(codec = 'ALAC', false) AND NOT alac THEN 'ALAC' WHEN coalesce(rb_depth, 0) > {} THEN rb_depth || '-bit' WHEN coalesce(rb_rate, 0) > 48000 THEN round(rb_rate / 1000)::INT || ' kHz' END"
VERDICTS = f"(SELECT id, device, {WHY.format('bits')} AS why, {WHY.format('low')} AS why_low FROM track t LEFT JOIN {CODEC} c ON c.path = t.path, {DEVICE_ROWS} WHERE coalesce(rb_length, 0) >= 60)"
FILES = f"""WITH {KEYED}, {FILE}, copies AS (SELECT id, count(*) OVER (PARTITION BY k_artist, k_base, k_version) AS n FROM keyed WHERE k_base <> ''),
    files AS (SELECT t.path, coalesce(f.size, 0) AS size, CASE WHEN t.rating = 5 THEN 'used' WHEN c.n > 1 THEN 'dupe' ELSE 'unique' END AS status FROM track t LEFT JOIN copies c ON c.id = t.id LEFT JOIN file f ON f.path = t.path WHERE t.path LIKE '/%/%'),
    parts AS (SELECT *, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS p FROM files), up AS (SELECT *, array_to_string(p[1:i], '/') AS folder FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM parts)),
    rollup_ AS (SELECT folder, count(*) AS audio, sum((status = 'used')::INT)::BIGINT AS used, sum((status = 'dupe')::INT)::BIGINT AS dupes, sum((status = 'unique')::INT)::BIGINT AS uniques, sum(size)::BIGINT AS bytes, sum(CASE WHEN status = 'dupe' THEN size ELSE 0 END)::BIGINT AS dupe_bytes FROM up GROUP BY folder)"""

ORACLES = {
    "probe_bitrate": f"WITH {FILE} SELECT path, bitrate, lossless FROM file",
    "dupe_groups": GROUPS + " SELECT k_artist, k_base, k_version, n, round(apart, 1) AS spread, tied, CASE WHEN short < 30 AND long > 60 THEN 'mistagged' WHEN apart <= 3 AND same_size THEN 'identical' WHEN apart <= 3 THEN 'duplicate' ELSE 'review' END AS verdict FROM groups",
    "dupe_best_copy": GROUPS + " SELECT k_artist, k_base, k_version, best FROM groups",
    "dupe_lost_tags": GROUPS + ", tag_of AS (SELECT g.best, c.id, unnest(c.mytags).name AS tag FROM copy c JOIN groups g USING (k_artist, k_base, k_version)) SELECT DISTINCT best, tag FROM tag_of a WHERE id <> best AND NOT EXISTS (SELECT 1 FROM tag_of b WHERE b.id = b.best AND b.best = a.best AND b.tag = a.tag)",
    "dupe_merge_plan": GROUPS + """, member AS (SELECT g.best, c.* EXCLUDE (k_artist, k_base, k_version) FROM copy c JOIN groups g USING (k_artist, k_base, k_version)),
        t AS (SELECT best, count(*) AS tags FROM (SELECT best, x FROM (SELECT best, id, unnest(mytags).id AS x FROM member) GROUP BY 1, 2 HAVING NOT bool_or(id = best)) GROUP BY 1),
        l AS (SELECT best, count(*) AS playlists FROM (SELECT best, x FROM (SELECT best, id, unnest(playlists).id AS x FROM member) GROUP BY 1, 2 HAVING NOT bool_or(id = best)) GROUP BY 1),
        r AS (SELECT best, max(CASE WHEN id = best THEN rating END) AS own, max(CASE WHEN id <> best THEN rating END) AS other FROM member GROUP BY 1)
        SELECT best, coalesce(tags, 0) AS tags, coalesce(playlists, 0) AS playlists, CASE WHEN other > own THEN other ELSE 0 END AS rating FROM r LEFT JOIN t USING (best) LEFT JOIN l USING (best)""",
    "work_score": f"SELECT id, ({WORK})::INT AS work FROM track",
    "device_compat": f"SELECT device, count(*) AS total, count(why) AS bad, round((count(*) - count(why)) / count(*) * 100, 1) AS pct, round((count(*) - count(why_low)) / count(*) * 100, 1) AS pct_low FROM {VERDICTS} GROUP BY device",
    "device_reasons": f"SELECT device, why, count(*) AS n FROM {VERDICTS} WHERE why IS NOT NULL GROUP BY 1, 2",
    "quality_bands": f"""WITH {FILE}, m AS (SELECT coalesce(nullif(duration, 0), rb_length, 0) AS seconds, coalesce(lossless, false) AS lossless, round(coalesce(bitrate, 0) / 1000) AS kbps FROM track t LEFT JOIN file f ON f.path = t.path)
        SELECT CASE WHEN seconds < 60 THEN 'clips' WHEN lossless THEN 'lossless' WHEN kbps = 0 THEN 'unknown' WHEN kbps <= 128 THEN 'le128' WHEN kbps <= 256 THEN 'le256' WHEN kbps <= 320 THEN 'le320' END AS band, count(*) AS n FROM m WHERE seconds < 60 OR lossless OR kbps <= 320 GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM m WHERE seconds >= 60""",
    "folder_rollup": FILES + " SELECT * FROM rollup_",
    "topmost_folders": FILES + ", fits AS (SELECT * FROM rollup_ WHERE used = 0 AND dupes >= 2 AND dupes >= 0.05 * audio) SELECT folder, audio, dupes FROM fits f WHERE NOT EXISTS (SELECT 1 FROM fits o WHERE starts_with(f.folder, o.folder || '/'))",
    "missing_and_orphans": """WITH refs AS (SELECT DISTINCT path FROM track WHERE path LIKE '/%'), disk AS (SELECT DISTINCT path FROM probe WHERE "exists"), diff AS (SELECT 'missing' AS side, path FROM (SELECT path FROM refs EXCEPT SELECT path FROM disk) UNION ALL SELECT 'orphan', path FROM (SELECT path FROM disk EXCEPT SELECT path FROM refs))
        SELECT side, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, count(*) AS n FROM diff GROUP BY 1, 2""",
    "storage_report": f"WITH {FILE}, sized AS (SELECT coalesce(codec, '(none)') AS item, sum(size)::BIGINT AS bytes, count(*) AS files FROM file GROUP BY 1) SELECT * FROM sized UNION ALL SELECT 'total', sum(bytes)::BIGINT, sum(files)::BIGINT FROM sized",
    "format_histogram": "SELECT ext, coalesce(rb_depth, 0) AS depth, count(*) AS n, sum(coalesce(rb_size, 0))::BIGINT AS bytes FROM track GROUP BY 1, 2",
    "same_recording": f"""WITH {KEYED}, k AS (SELECT id, rb_length AS l, k_artist || chr(31) || k_base || chr(31) || k_version AS k FROM keyed WHERE k_base <> '' AND rb_length > 0),
        o AS (SELECT *, sum(CASE WHEN l - prev <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY l, id) AS chain FROM (SELECT *, lag(l) OVER (PARTITION BY k ORDER BY l, id) AS prev FROM k)),
        c AS (SELECT *, min(id) OVER (PARTITION BY k, chain) AS class_id FROM o)
        SELECT c.id, class_id, count(*) AS links FROM c JOIN k b ON b.k = c.k AND b.id <> c.id AND abs(b.l - c.l) <= 3 GROUP BY 1, 2""",
    "merged_sets": GROUPS + """, member AS (SELECT g.best, c.id, c.mytags, c.playlists FROM copy c JOIN groups g USING (k_artist, k_base, k_version)),
        x AS (SELECT best, id, 'tag' AS kind, t.id AS xid, t.name AS name FROM (SELECT best, id, unnest(mytags) AS t FROM member) UNION ALL SELECT best, id, 'playlist', p.id, p.name FROM (SELECT best, id, unnest(playlists) AS p FROM member))
        SELECT best, kind, xid AS id, min(name) AS name FROM x GROUP BY best, kind, xid HAVING NOT bool_or(id = best)""",
    "dupe_order": GROUPS + """, v AS (SELECT k_artist, k_base, k_version, n, CASE WHEN short < 30 AND long > 60 THEN 'mistagged' WHEN apart <= 3 AND same_size THEN 'identical' WHEN apart <= 3 THEN 'duplicate' ELSE 'review' END AS verdict FROM groups)
        SELECT row_number() OVER (ORDER BY list_position(['identical', 'duplicate', 'review', 'mistagged'], verdict), k_artist, k_base, k_version) AS pos, k_artist, k_base, k_version, verdict FROM v WHERE NOT (verdict = 'review' AND n = 2) QUALIFY pos <= 200""",
    "held_files": f"""WITH {KEYED}, {FILE}, r AS (SELECT k.id, k.path, k_artist, k_base, k_version, rb_length, rating, size, duration, trim(regexp_replace(regexp_replace({FOLD.format("regexp_extract(k.path, '([^/]*?)(\\.[^./]*)?$', 1)")}, '[&+]', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS stem FROM keyed k JOIN file f ON f.path = k.path AND f."exists"),
        lib AS (SELECT * FROM r WHERE rating = 5), loose AS (SELECT * FROM r WHERE path NOT IN (SELECT path FROM lib)),
        exact AS (SELECT a.path, min(b.path) AS orig FROM loose a JOIN lib b ON b.size = a.size AND b.duration IS NOT DISTINCT FROM a.duration GROUP BY 1),
        same AS (SELECT a.path, min_by(b.path, (CASE WHEN a.k_base <> '' AND b.k_base <> '' AND a.k_artist = b.k_artist AND a.k_base = b.k_base AND a.k_version = b.k_version THEN '0' ELSE '1' END) || b.path) AS orig FROM loose a JOIN lib b ON b.rb_length > 0 AND abs(b.rb_length - a.duration) <= 3
            AND ((a.k_base <> '' AND b.k_base <> '' AND a.k_artist = b.k_artist AND a.k_base = b.k_base AND a.k_version = b.k_version) OR a.stem = b.stem) WHERE a.path NOT IN (SELECT path FROM exact) AND a.duration IS NOT NULL GROUP BY 1)
        SELECT path, 'identical' AS how, orig FROM exact UNION ALL SELECT path, 'same', orig FROM same""",
    "folder_order": FILES + " SELECT row_number() OVER (ORDER BY dupe_bytes DESC, folder) AS pos, folder, dupes, dupe_bytes FROM rollup_ WHERE dupes > 0 QUALIFY pos <= 200",
    "space_check": f"""WITH {FILE}, t AS (SELECT t.path, f.size AS fsize, lower(regexp_replace(t.path, '\\.[^./]*$', '') || '.aiff') IN (SELECT lower(path) FROM file WHERE "exists") AS taken FROM track t LEFT JOIN file f ON f.path = t.path AND f."exists" WHERE lower(ext) = '.flac'),
        g AS (SELECT CASE WHEN fsize IS NULL THEN 'gone' WHEN taken THEN 'taken' ELSE 'todo' END AS state, count(*) AS n, coalesce(sum(fsize), 0)::BIGINT AS bytes FROM t GROUP BY 1) SELECT state, n, bytes, CASE WHEN state = 'todo' THEN round(bytes * 1.55::DOUBLE, 2) ELSE 0 END AS need, CASE WHEN state = 'todo' THEN bytes * 1.55 ELSE 0 END <= 20e9 * 0.95 AS fits FROM g""",
    "format_issues": f"""WITH v AS (SELECT CASE WHEN t.ext = '.flac' THEN 'FLAC' ELSE d.why END AS why, t.path FROM {VERDICTS} d JOIN track t USING (id) WHERE device = 'nxs2'), r AS (SELECT *, row_number() OVER (PARTITION BY why ORDER BY path) AS r FROM v WHERE why IS NOT NULL)
        SELECT why, count(*) AS n, string_agg(CASE WHEN r <= 60 THEN path END, '|' ORDER BY path) AS files FROM r GROUP BY 1""",
    "paths_found": "WITH w AS (SELECT DISTINCT upper(path) AS path FROM probe), r AS (SELECT lower(path) AS low, id, coalesce(rating, 0) > 0 AS live FROM track QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY coalesce(rating, 0) > 0 DESC, id) = 1) SELECT w.path, r.id, r.live FROM w LEFT JOIN r ON r.low = lower(w.path)",
    "file_identities": "SELECT CASE WHEN size <> 0 AND rate IS NOT NULL THEN 'fs:' || size || ':' || rate ELSE 'path:' || lower(path) END AS identity, count(*) AS n, min(path) AS path FROM (SELECT DISTINCT path, size, rate FROM probe WHERE path IS NOT NULL) GROUP BY 1",
    "missing_artwork": f"""WITH c AS (SELECT content_id AS id, tag_id AS url, max(round(seq / 10.0, 2)) AS score, bool_and(regexp_matches(name, '{COMPILATION}') AND trim(name) <> '') AS compilation, bool_or(deleted = 0) AS same_version FROM song_tag s JOIN tag t ON t.id = s.tag_id GROUP BY 1, 2),
        k AS (SELECT id, count(*) AS n, max(CASE WHEN r = 1 THEN url END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, compilation, same_version DESC, url) AS r FROM c WHERE score >= 0.55) WHERE r <= 4 GROUP BY 1)
        SELECT t.id, t.id IN (SELECT id FROM c) AS looked, coalesce(t.rating = 5, false) AS queued, best, coalesce(n, 0) AS n FROM track t LEFT JOIN k ON k.id = t.id WHERE coalesce(color, '') = ''""",
    "copy_labels": f"""WITH {FILE} SELECT t.id, CASE WHEN NOT coalesce(f."exists", false) THEN 'file not found' WHEN lossless THEN rtrim(coalesce(codec, '?') || ' ' || concat_ws(' / ', CASE WHEN rate > 0 THEN replace(printf('%.1f', rate / 1000.0), '.0', '') || ' kHz' END, CASE WHEN depth > 0 THEN depth || '-bit' END))
        WHEN round_even(coalesce(bitrate, 0) / 1000.0, 0) > 0 THEN coalesce(codec, '?') || ' ' || round_even(coalesce(bitrate, 0) / 1000.0, 0)::INT || ' kbps' ELSE coalesce(codec, '?') END AS quality,
        concat_ws(', ', CASE WHEN len(mytags) > 0 THEN len(mytags) || CASE WHEN len(mytags) = 1 THEN ' tag' ELSE ' tags' END END, CASE WHEN cues > 0 THEN cues || ' cues' END, CASE WHEN comment <> '' THEN 'a comment' END, CASE WHEN rating <> 0 THEN 'a rating' END) AS work FROM track t LEFT JOIN file f ON f.path = t.path""",
}
