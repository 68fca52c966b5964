"""Queries over change logs and stored copies. The events table plays the log's and the copies' part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlore.operators import journal as op
from setlore.operators import learning
from setlore.operators.library import playlist_entries
from setlore.operators.measures import global_rank
from setlore.tables import load

NOW = "2024-01-31 00:00:00"


def _log(s: SparkSession, d: str) -> DataFrame:
    """The events as a change log: users stand for tracks, the kind of event and its k for the operation."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    viewed = F.when(k % 4 == 0, "playlist_add").when(k % 4 == 1, "playlist_remove").when(k % 4 == 2, "set_color").otherwise("browse")
    op_ = F.when(kind == "signup", "add_tag").when(kind == "error", "remove_tag").when(kind == "click", "set_comment").when(kind == "purchase", "set_rating").otherwise(viewed)
    rows = load(s, d, "events").select(F.col("event_id").alias("seq"), op_.alias("op"), F.col("user_id").cast("string").alias("track"), k.alias("k"), F.round("value", 2).cast("string").alias("value"))
    return rows.select("seq", "op", "track", F.when(F.col("op").isin("add_tag", "remove_tag"), F.concat(F.lit("t"), F.pmod("k", F.lit(10)))).alias("tag"), F.when(F.startswith("op", F.lit("playlist")), F.concat(F.lit("p"), F.pmod("k", F.lit(5)))).alias("playlist"), "value", F.when(F.pmod("k", F.lit(3)) > 0, F.col("k").cast("string")).alias("before"))


def oplog_compact(s: SparkSession, d: str) -> DataFrame:
    return op.compact(_log(s, d))


def _base(s: SparkSession, d: str) -> DataFrame:
    """Current values of every customer: tags t0 and t1, the playlist p1 and a rating."""
    users = load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("track"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in (("tag:t0", "1"), ("tag:t1", "1"), ("list:p1", "1"), ("rating", "5"))])
    return users.select("track", F.explode(fields).alias("f")).select("track", "f.field", "f.value")


def oplog_effective(s: SparkSession, d: str) -> DataFrame:
    return op.effective(_base(s, d), op.compact(_log(s, d)))


def oplog_apply(s: SparkSession, d: str) -> DataFrame:
    """Outcomes over the customers with a balance; the others are missing."""
    tracks = load(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("track"))
    return op.apply(_base(s, d), op.compact(_log(s, d)), tracks).groupBy("op", "outcome").agg(F.count("*").alias("n"))


def _songs(s: SparkSession, d: str) -> DataFrame:
    """The change log on tracks: users by number stand for tracks by the place of their id."""
    return global_rank(load(s, d, "track_view").select("id"), [F.col("id")], "i").select(F.col("i").cast("string").alias("track"), "id")


def browse_rows(s: SparkSession, d: str) -> DataFrame:
    """Tracks with waiting changes as they will be, beside what the library holds."""
    log = op.compact(_log(s, d)).join(_songs(s, d), "track").drop("track").withColumnRenamed("id", "track")
    rows = op.browse_rows(load(s, d, "track_view"), log)
    return rows.select("id", "title", "artist", "genre", "rating", "comment", "color", F.array_join("tags", "|").alias("tags"), F.col("base.comment").alias("base_comment"), F.col("base.rating").alias("base_rating"))


def playlist_membership(s: SparkSession, d: str) -> DataFrame:
    """Which of the playlists p0 to p4 each track with a waiting change will be in; p1 holds every customer."""
    lists = s.createDataFrame([(f"p{i}",) for i in range(5)], "playlist string")
    entries = load(s, d, "customer").select(F.lit("p1").alias("playlist"), F.col("c_custkey").cast("string").alias("track"))
    return op.membership(lists, entries, op.compact(_log(s, d)))


def link_states(s: SparkSession, d: str) -> DataFrame:
    """The documents' tags as links into the tag table: pending where there is none, gone where it is a group."""
    links = load(s, d, "documents").groupBy("tag_id").agg(F.count("*").alias("n")).select(F.coalesce("tag_id", F.lit("none")).alias("link"), F.coalesce("tag_id", F.lit("new:none")).alias("playlist"))
    return op.link_states(links, load(s, d, "tag").where("attribute = 0 and seq < 5").select(F.col("id").alias("playlist"), "name"))


def queue_summary(s: SparkSession, d: str) -> DataFrame:
    return op.compact(_log(s, d)).agg(F.count("*").alias("n"), F.countDistinct("track").alias("tracks"), F.min("seq").alias("oldest"))


def playlist_sync(s: SparkSession, d: str) -> DataFrame:
    """What the first playlist lacks of all others, without what the second one brought before."""
    entries = playlist_entries(load(s, d, "track")).select("playlist", "track").distinct()
    first = entries.agg(F.min("playlist").alias("playlist"))
    have = entries.join(F.broadcast(first), "playlist", "left_semi")
    wanted = entries.select("track").crossJoin(F.broadcast(first)).select("playlist", "track")
    second = entries.join(F.broadcast(first), "playlist", "left_anti").agg(F.min("playlist").alias("other"))
    added = entries.join(F.broadcast(second), F.col("playlist") == F.col("other"), "left_semi").select("track").crossJoin(F.broadcast(first)).select("playlist", "track")
    return op.sync(have, wanted, added)


def retention_tiers(s: SparkSession, d: str) -> DataFrame:
    return op.keep(load(s, d, "events").select(F.col("ts").alias("stamp")), F.lit(NOW).cast("timestamp"))


def byte_budget(s: SparkSession, d: str) -> DataFrame:
    kept = op.keep(load(s, d, "events").select(F.col("ts").alias("stamp")), F.lit(NOW).cast("timestamp"))
    sizes = load(s, d, "events").groupBy(F.col("ts").alias("stamp")).agg(F.min("event_id").alias("id"), F.sum(F.round("value", 2)).alias("bytes"))
    return op.within_budget(kept.join(sizes, "stamp"), 500.0)


def _copies(s: SparkSession, d: str) -> DataFrame:
    """The events as stored copies of three kinds, one a second."""
    kind = F.when(F.col("event_type").isin("click", "view"), "db").when(F.col("event_type") == "purchase", "xml").when(F.col("event_type") == "signup", "tables").otherwise("other")
    return load(s, d, "events").select(kind.alias("kind"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("stamp"), F.floor("value").alias("bytes"))


def copies_listing(s: SparkSession, d: str) -> DataFrame:
    return op.copies_listing(_copies(s, d))


def copies_status(s: SparkSession, d: str) -> DataFrame:
    return op.copies_status(op.copies_listing(_copies(s, d)), F.lit(NOW).cast("timestamp"))


def lesson_answers(s: SparkSession, d: str) -> DataFrame:
    """The last answer of every user to yes (click) and no (view) questions; an error takes all back."""
    log = load(s, d, "events").where("event_type in ('click', 'view', 'error')").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "yes").when(F.col("event_type") == "view", "no").otherwise("forget").alias("answer"))
    return learning.last_answers(log)


def learning_curve(s: SparkSession, d: str) -> DataFrame:
    """The points of a curve: days, how many answers so far, and their mean, where either changed."""
    days = load(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"), F.round(F.sum("value"), 2).alias("v"))
    return learning.curve(days.select(F.col("day").cast("string").alias("at"), F.floor(F.col("c") / 100).alias("n"), F.round(F.floor(F.col("v") / 1000), 2).alias("score")))


QUERIES = {f.__name__: f for f in (oplog_compact, oplog_effective, oplog_apply, browse_rows, playlist_membership, link_states, queue_summary, playlist_sync, retention_tiers, byte_budget, copies_listing, copies_status, lesson_answers, learning_curve)}

LOG = """(SELECT *, CASE WHEN op IN ('add_tag', 'remove_tag') THEN 'tag:t' || (k % 10) WHEN op IN ('playlist_add', 'playlist_remove') THEN 'list:p' || (k % 5) ELSE regexp_replace(op, '^set_', '') END AS field, CASE WHEN k % 3 > 0 THEN k::VARCHAR END AS before
    FROM (SELECT event_id AS seq, user_id::VARCHAR AS track, (props->>'$.k')::INT AS k, round(value, 2)::VARCHAR AS value,
    CASE event_type WHEN 'signup' THEN 'add_tag' WHEN 'error' THEN 'remove_tag' WHEN 'click' THEN 'set_comment' WHEN 'purchase' THEN 'set_rating' ELSE CASE (props->>'$.k')::INT % 4 WHEN 0 THEN 'playlist_add' WHEN 1 THEN 'playlist_remove' WHEN 2 THEN 'set_color' ELSE 'browse' END END AS op FROM events))"""
COMPACT = f"""(SELECT track, field, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value, CASE WHEN field IN ('comment', 'rating', 'color') THEN min_by(before, seq) FILTER (WHERE before IS NOT NULL) ELSE arg_max_null(before, seq) END AS before
    FROM {LOG} WHERE op <> 'browse' AND track <> '' GROUP BY track, field)"""
USERS = "(SELECT c_custkey::VARCHAR AS track FROM customer)"
BASE = f"(SELECT track, f.field, f.value FROM (SELECT track, unnest([{{'field': 'tag:t0', 'value': '1'}}, {{'field': 'tag:t1', 'value': '1'}}, {{'field': 'list:p1', 'value': '1'}}, {{'field': 'rating', 'value': '5'}}]) AS f FROM {USERS}))"
COPIES = """(SELECT date_trunc('second', ts) AS stamp, bool_or(kind = 'db') AS db, bool_or(kind = 'xml') AS xml, bool_or(kind = 'tables') AS tables, sum(bytes)::BIGINT AS bytes
    FROM (SELECT ts, floor(value)::BIGINT AS bytes, CASE WHEN event_type IN ('click', 'view') THEN 'db' WHEN event_type = 'purchase' THEN 'xml' WHEN event_type = 'signup' THEN 'tables' END AS kind FROM events) WHERE kind IS NOT NULL AND ts IS NOT NULL GROUP BY 1)"""
KEPT = f"""(SELECT DISTINCT stamp FROM (SELECT max(ts) AS stamp FROM events
    UNION ALL SELECT ts FROM events WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 21600
    UNION ALL SELECT max(ts) FROM events WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 172800 GROUP BY strftime(ts, '%Y%m%d%H')
    UNION ALL SELECT max(ts) FROM events WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 1209600 GROUP BY strftime(ts, '%Y%m%d')
    UNION ALL SELECT max(ts) FROM events WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 4838400 GROUP BY strftime(ts, '%G-%V')
    UNION ALL SELECT max(ts) FROM events GROUP BY strftime(ts, '%Y%m')) WHERE stamp IS NOT NULL)"""
ORACLES = {
    "oplog_compact": f"SELECT * FROM {COMPACT}",
    "oplog_effective": f"SELECT track, field, CASE WHEN op IS NULL THEN b.value WHEN op LIKE 'set_%' THEN c.value ELSE '1' END AS value FROM {BASE} b FULL JOIN {COMPACT} c USING (track, field) WHERE coalesce(op, '') NOT IN ('remove_tag', 'playlist_remove')",
    "oplog_apply": f"""SELECT op, outcome, count(*) AS n FROM (SELECT c.op, CASE WHEN u.track IS NULL THEN 'missing' WHEN c.op NOT LIKE 'set_%' THEN CASE WHEN (b.value IS NOT NULL) = (c.op IN ('add_tag', 'playlist_add')) THEN 'same' ELSE 'applied' END
        WHEN coalesce(b.value, '') = coalesce(c.value, '') THEN 'same' WHEN before IS NOT NULL AND (CASE c.op WHEN 'set_rating' THEN coalesce(nullif(b.value, ''), '0') <> coalesce(nullif(before, ''), '0') WHEN 'set_color' THEN lower(trim(coalesce(b.value, ''))) <> lower(trim(before)) ELSE coalesce(b.value, '') <> before END) THEN 'skipped' ELSE 'applied' END AS outcome
        FROM {COMPACT} c LEFT JOIN {BASE} b ON b.track = c.track AND b.field = c.field LEFT JOIN (SELECT c_custkey::VARCHAR AS track FROM customer WHERE c_acctbal > 0) u ON u.track = c.track) GROUP BY 1, 2""",
    "browse_rows": f"""WITH song AS (SELECT id, (row_number() OVER (ORDER BY id) - 1)::VARCHAR AS track FROM track_view), c AS (SELECT s.id, k.* EXCLUDE (track) FROM {COMPACT} k JOIN song s USING (track)),
        tag AS (SELECT v.id, t FROM track_view v, unnest(coalesce(v.tags, [])) AS u(t) WHERE t IS NOT NULL AND t <> '' UNION SELECT id, substr(field, 5) FROM c WHERE op = 'add_tag'),
        kept AS (SELECT id, string_agg(t, '|' ORDER BY t) AS tags FROM tag WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = tag.id AND c.op = 'remove_tag' AND c.field = 'tag:' || t) GROUP BY id)
        SELECT v.id, coalesce(title, '') AS title, coalesce(artist, '') AS artist, coalesce(array_to_string(genres, '/'), '') AS genre, CASE WHEN r.op IS NULL THEN coalesce(rating, 0)::VARCHAR ELSE r.value END AS rating, CASE WHEN m.op IS NULL THEN coalesce(comment, '') ELSE m.value END AS comment,
            CASE WHEN k.op IS NULL THEN trim(coalesce(color, '')) ELSE k.value END AS color, coalesce(kept.tags, '') AS tags, coalesce(comment, '') AS base_comment, coalesce(rating, 0)::VARCHAR AS base_rating
        FROM track_view v LEFT JOIN kept ON kept.id = v.id LEFT JOIN c r ON r.id = v.id AND r.field = 'rating' LEFT JOIN c m ON m.id = v.id AND m.field = 'comment' LEFT JOIN c k ON k.id = v.id AND k.field = 'color'""",
    "playlist_membership": f"""WITH change AS (SELECT track, substr(field, 6) AS playlist, op = 'playlist_add' AS adds FROM {COMPACT} WHERE field LIKE 'list:%'), held AS (SELECT c_custkey::VARCHAR AS track, 'p1' AS playlist FROM customer WHERE c_custkey::VARCHAR IN (SELECT track FROM change))
        SELECT track, playlist, coalesce(adds, true) AS has FROM held FULL JOIN change USING (track, playlist)""",
    "link_states": """WITH l AS (SELECT coalesce(tag_id, 'none') AS link, coalesce(tag_id, 'new:none') AS playlist FROM documents GROUP BY tag_id), p AS (SELECT id, name FROM tag WHERE attribute = 0 AND seq < 5)
        SELECT link, coalesce(name, '') AS name, playlist LIKE 'new:%' AS pending, playlist NOT LIKE 'new:%' AND name IS NULL AND (SELECT count(*) FROM p) > 0 AS gone FROM l LEFT JOIN p ON p.id = playlist""",
    "copies_listing": f"SELECT * FROM {COPIES}",
    "copies_status": f"SELECT count(*) AS copies, max(stamp) AS last, max(CASE WHEN xml THEN stamp END) AS last_text, sum(bytes)::BIGINT AS bytes, (epoch(TIMESTAMP '{NOW}') - epoch(max(stamp)))::BIGINT AS age FROM {COPIES}",
    "lesson_answers": """WITH a AS (SELECT user_id::VARCHAR AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no' ELSE 'forget' END AS answer FROM events WHERE event_type IN ('click', 'view', 'error'))
        SELECT id, seq, answer FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1 AND answer <> 'forget'""",
    "learning_curve": """WITH day AS (SELECT strftime(ts, '%Y-%m-%d') AS at_, floor(count(*) / 100)::BIGINT AS n, floor(round(sum(value), 2) / 1000)::DOUBLE AS score FROM events WHERE ts IS NOT NULL GROUP BY 1),
        c AS (SELECT *, lag(n) OVER w AS n0, lag(score) OVER w AS s0, min(n) OVER (ORDER BY at_ ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM day WINDOW w AS (ORDER BY at_)),
        p AS (SELECT * FROM c WHERE n0 IS NULL OR n <> n0 OR score <> s0)
        SELECT at_ AS "at", n, score FROM (SELECT *, min(n) OVER (ORDER BY at_ ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM p) WHERE after IS NULL OR n < after ORDER BY at_ DESC LIMIT 200""",
    "queue_summary": f"SELECT count(*) AS n, count(DISTINCT track) AS tracks, min(seq) AS oldest FROM {COMPACT}",
    "playlist_sync": """WITH e AS (SELECT DISTINCT p.id AS playlist, id AS track FROM (SELECT id, unnest(playlists) AS p FROM track)), f AS (SELECT min(playlist) AS playlist FROM e), g AS (SELECT min(playlist) AS playlist FROM e WHERE playlist <> (SELECT playlist FROM f))
        SELECT DISTINCT f.playlist, e.track FROM e, f WHERE e.track NOT IN (SELECT track FROM e WHERE playlist IN (SELECT playlist FROM f)) AND e.track NOT IN (SELECT track FROM e WHERE playlist IN (SELECT playlist FROM g))""",
    "retention_tiers": f"SELECT stamp FROM {KEPT}",
    "byte_budget": f"SELECT id, row_number() OVER (ORDER BY stamp DESC, id DESC) <= 2 OR sum(bytes) OVER (ORDER BY stamp DESC, id DESC ROWS UNBOUNDED PRECEDING) <= 500.0 AS kept FROM {KEPT} JOIN (SELECT ts AS stamp, min(event_id) AS id, sum(round(value, 2)) AS bytes FROM events GROUP BY 1) USING (stamp)",
}
