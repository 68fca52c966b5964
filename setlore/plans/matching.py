"""Queries over titles, words and references found in text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setlore.functions import text as tx
from setlore.operators import matching as op
from setlore.operators.vocabulary import genre_cloud
from setlore.plans.library import FOLD
from setlore.plans.quality import KEYED
from setlore.session import materialise
from setlore.sources.references import MUSIC, dates_in, fingerprints, links_in, listed, referenced_paths
from setlore.tables import load


def title_parts(s: SparkSession, d: str) -> DataFrame:
    base, version = tx.split_title(F.col("title"))
    return load(s, d, "track").select("id", tx.words(F.col("title"), compat=True).alias("folded"), base.alias("base"), version.alias("version"), tx.primary_artist(F.col("artist")).alias("artist"))


def base_titles(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").select("id", tx.base_title(F.col("title"), compat=True).alias("base"), tx.version_of(F.col("title"), compat=True).alias("version"))


def dash_split(s: SparkSession, d: str) -> DataFrame:
    artist, title = tx.split_dash(F.coalesce("title", F.lit("")))
    return load(s, d, "track").select("id", artist.alias("artist"), title.alias("title"))


def safe_names(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").select("id", tx.safe_name(F.col("title")).alias("name"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Songs to look for: the rows whose id is divisible by 50, by the title and artist of the view."""
    rows = load(s, d, "track_view").where(F.col("id").cast("bigint") % 50 == 0)
    return rows.select(F.col("id").alias("aid"), "title", "artist")


def token_jaccard_match(s: SparkSession, d: str) -> DataFrame:
    """Base titles that share at least half of their words with an asked one."""
    found = op.similar_words(_asked(s, d), load(s, d, "track").select("id", "title", "artist"))
    return found.withColumns({"jaccard": F.round("jaccard", 6), "containment": F.round("containment", 6)})


def block_candidates(s: SparkSession, d: str) -> DataFrame:
    """How many of the library's songs share a blocking word with each asked one, before anything is compared."""
    return op.block_counts(_asked(s, d), load(s, d, "track").select("id", "title", "artist"))


def blocked_similarity(s: SparkSession, d: str) -> DataFrame:
    return op.blocked_matches(_asked(s, d), load(s, d, "track").select("id", "title", "artist"))


def playlist_check(s: SparkSession, d: str) -> DataFrame:
    """The asked songs beside the library, with a pair made by hand for those with five stars and all of two stars known as not to be found."""
    track = load(s, d, "track")
    asked = materialise(_asked(s, d).withColumnRenamed("aid", "key"))
    rated = materialise(track.where("rating in (2, 5)").select(F.col("id").alias("key"), "rating").join(asked.select("key"), "key", "left_semi"))
    vain = asked.join(rated.where("rating = 2"), "key").select(tx.unfindable_key(F.col("artist"), F.col("title"), F.lit("")).alias("song"))
    return op.playlist_check(asked, track.select("id", "title", "artist"), rated.where("rating = 5").select("key", F.col("key").alias("id")), vain)


def lookup_texts(s: SparkSession, d: str) -> DataFrame:
    """What each track is looked up by, the key under which it would be remembered as not found, and what its file name says."""
    artist, title = tx.file_stem(F.col("path"))
    return load(s, d, "track").select("id", tx.search_query(F.col("title"), F.col("artist")).alias("query"), tx.unfindable_key(F.col("artist"), F.col("title"), F.lit("")).alias("unfindable"), artist.alias("file_artist"), title.alias("file_title"))


def compilations(s: SparkSession, d: str) -> DataFrame:
    """Tracks whose comment, standing for the album, names a compilation."""
    return load(s, d, "track").where(tx.is_compilation(F.col("comment"), F.col("title"))).select("id")


#: Frames that the sources of documents stand for.
FRAMES = ("TALB", "COMM::eng", "TENC", "WOAF", "TXXX:pool-user", "TIT2", "publisher")


def frame_branding(s: SparkSession, d: str) -> DataFrame:
    """Texts as tags of files, their sources in order of name as seven frames: how many are a brand, a branded album, or belong (P10)."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(FRAMES) for x in (i, k)])
    sources = load(s, d, "source_target").select("source", place[F.row_number().over(Window.orderBy("source")) - 1].alias("key"))
    rows = load(s, d, "documents").join(sources, "source").select("key", tx.frame_kind(F.lit("ID3"), F.col("key"), F.col("text")).alias("kind"))
    return rows.groupBy("key", "kind").agg(F.count("*").alias("n"))


def library_search(s: SparkSession, d: str) -> DataFrame:
    return op.search(load(s, d, "track_view"), "velvet staircase")


def genre_issues(s: SparkSession, d: str) -> DataFrame:
    return op.genre_issues(genre_cloud(load(s, d, "track_view")))


def already_owned(s: SparkSession, d: str) -> DataFrame:
    """Asked songs that the library holds under the duplicate key, and how often."""
    from setlore.operators.quality import KEY, keyed

    owned = keyed(load(s, d, "track")).groupBy(*KEY).agg(F.count("*").alias("copies"))
    asked = keyed(_asked(s, d).withColumnRenamed("aid", "id"))
    return asked.join(owned, list(KEY)).select("id", "copies")


def found_paths(s: SparkSession, d: str) -> DataFrame:
    return referenced_paths(load(s, d, "documents"), "doc_id", "text")


def found_dates(s: SparkSession, d: str) -> DataFrame:
    return dates_in(load(s, d, "documents"), "text")


def listed_files(s: SparkSession, d: str) -> DataFrame:
    """Music below /Music by extension and what an import would do with it."""
    return listed(load(s, d, "track").select("path"), "/Music").groupBy("ext", "kind").agg(F.count("*").alias("n"))


def found_links(s: SparkSession, d: str) -> DataFrame:
    return links_in(load(s, d, "documents"), "doc_id", "text")


def file_prints(s: SparkSession, d: str) -> DataFrame:
    """The fingerprints of the measured files, their lengths standing for the time of change."""
    return fingerprints(load(s, d, "probe").where("path is not null").select("path", F.nullif("size", F.lit(0)).alias("size"), "duration").distinct(), "size", "duration")


QUERIES = {f.__name__: f for f in (listed_files, found_links, file_prints, title_parts, base_titles, dash_split, safe_names, token_jaccard_match, block_candidates, blocked_similarity, playlist_check, lookup_texts, compilations, frame_branding, library_search, genre_issues, already_owned, found_paths, found_dates)}

WORDS = "trim(regexp_replace(" + FOLD + ", '[^a-z0-9]+', ' ', 'g'))"


def compatibility_rows() -> str:
    """The rows (c, t) of characters whose compatibility decomposition, without combining marks, holds letters a to z or digits, or nothing at all."""
    rows = []
    for code in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1F300)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        text = re.sub("[^a-z0-9]+", " ", plain)
        if text.strip() or not plain:
            rows.append(f"('{chr(code)}', '{text}')")
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") AS m(c, t))"


COMPATIBLE = f"compat AS MATERIALIZED {compatibility_rows()}"


def words_sql(name: str, table: str, key: str, text: str) -> str:
    """The CTE `name` (key, t): the matching form, by NFKD, of a text of each row of a table. Pure ASCII rows need no table of characters."""
    return f"""{name}_c AS (SELECT {key} AS key, {text} AS x FROM {table}),
        {name}_o AS (SELECT key, any_value(x) AS x, string_agg(coalesce(m.t, c.ch), '' ORDER BY i) AS y FROM (SELECT key, x, unnest(string_split(x, '')) AS ch, unnest(range(len(string_split(x, '')))) AS i FROM {name}_c WHERE regexp_matches(x, '[^\\x00-\\x7F]')) c LEFT JOIN compat m ON m.c = c.ch GROUP BY key),
        {name} AS (SELECT k.key, trim(regexp_replace(lower(coalesce(o.y, k.x)), '[^a-z0-9]+', ' ', 'g')) AS t FROM {name}_c k LEFT JOIN {name}_o o USING (key))"""


BRACKETS = r"regexp_replace(coalesce(title, ''), '[(\[{][^)\]}]*[)\]}]', ' ', 'g')"
BARE_TEXT = rf"regexp_replace({BRACKETS}, '(?is)\b(feat|ft|featuring|with)\.?\s+.*$', ' ')"
INSIDE_TEXT = r"array_to_string(regexp_extract_all(coalesce(title, ''), '[(\[{][^)\]}]*[)\]}]'), ' ')"
PAIRS, SINGLES = "|".join(w for w in tx.VERSIONS if " " in w), "|".join(w for w in tx.VERSIONS if " " not in w)


def bases_sql(name: str, table: str, key: str = "id") -> str:
    """The CTE `name` (key, base): base titles, version words taken off in two rounds."""
    return words_sql(f"{name}_w", table, key, BARE_TEXT) + f""",
        {name} AS (SELECT key, CASE WHEN s = '' THEN t ELSE s END AS base FROM (SELECT key, t, trim(regexp_replace(trim(regexp_replace(t, '(?:(?:^|\\s)(?:{PAIRS}))+$', '')), '(?:(?:^|\\s)(?:{SINGLES}))+$', '')) AS s FROM {name}_w))"""


ASKED = "(SELECT * FROM track_view WHERE id::BIGINT % 50 = 0)"
BLOCKING = "('the', 'and', 'feat', 'featuring', 'mix', 'remix', 'edit', 'original', 'extended', 'radio', 'version', 'club', 'dub', 'vip', 'with')"
VERSION_ROWS = ", ".join(f"('{w}', {i})" for i, w in enumerate(tx.VERSIONS))
ORACLES = {
    "listed_files": rf"""WITH f AS (SELECT lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext, string_split(substr(path, 8), '/') AS p FROM track WHERE path LIKE '/Music/%')
        SELECT ext, CASE WHEN ext = '.flac' THEN 'convert' ELSE 'copy' END AS kind, count(*) AS n FROM f WHERE ext IN {MUSIC} AND p[1] <> 'processed' AND NOT list_bool_or(list_transform(p, lambda x: starts_with(x, '.'))) AND NOT coalesce(list_bool_or(list_transform(p[1:-2], lambda x: regexp_matches(lower(x), '\.(app|logicx|band|photoslibrary|musiclibrary)$'))), false) GROUP BY 1, 2""",
    "found_links": r"""SELECT doc_id, url, CASE WHEN regexp_matches(h, 'spotify\.link|app\.link|on\.soundcloud\.com') THEN 'short' WHEN contains(h, 'spotify') THEN 'spotify' WHEN contains(h, 'soundcloud') THEN 'soundcloud' ELSE 'none' END AS source
        FROM (SELECT doc_id, regexp_replace(u, '[).,;\]]+$', '') AS url, lower(regexp_extract(u, '^https?://([^/:?#]*)', 1)) AS h FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'https?://\S+'))) AS u FROM documents))""",
    "file_prints": """SELECT DISTINCT path, CASE WHEN size <> 0 AND duration IS NOT NULL THEN size || ':' || floor(duration)::BIGINT ELSE '-' END AS print FROM probe WHERE path IS NOT NULL""",
    "title_parts": f"WITH {KEYED}, {COMPATIBLE}, {words_sql('f', 'track', 'id', "coalesce(title, ' ')")} SELECT id, f.t AS folded, k_base AS base, k_version AS version, k_artist AS artist FROM keyed JOIN f ON f.key = id",
    "base_titles": f"""WITH {COMPATIBLE}, {bases_sql('b', 'track')}, {words_sql('v', 'track', 'id', INSIDE_TEXT)}
        SELECT b.key AS id, base, coalesce((SELECT w FROM (VALUES {VERSION_ROWS}) AS l(w, i) WHERE contains(v.t, w) ORDER BY length(w) DESC, i LIMIT 1), '') AS version FROM b JOIN v USING (key)""",
    "dash_split": r"SELECT id, CASE WHEN regexp_matches(t, '^(.*?)\s+[-–—]\s+(.*)$') THEN trim(regexp_extract(t, '^(.*?)\s+[-–—]\s+(.*)$', 1)) ELSE '' END AS artist, CASE WHEN regexp_matches(t, '^(.*?)\s+[-–—]\s+(.*)$') THEN trim(regexp_extract(t, '^(.*?)\s+[-–—]\s+(.*)$', 2)) ELSE trim(t) END AS title FROM (SELECT id, coalesce(title, '') AS t FROM track)",
    "safe_names": r"SELECT id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[/:\\]', '-', 'g'), '[\x00-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 150) AS name FROM track",
    "token_jaccard_match": f"""WITH {COMPATIBLE}, {bases_sql('l', 'track')}, {bases_sql('q', ASKED)}, r AS (SELECT base, count(*) AS copies, list_distinct(list_filter(string_split(base, ' '), lambda w: w <> '')) AS b FROM l GROUP BY base),
        a AS (SELECT key AS aid, list_distinct(list_filter(string_split(base, ' '), lambda w: w <> '')) AS a FROM q), p AS (SELECT *, len(list_intersect(a, b)) AS c FROM a, r WHERE list_has_any(a, b))
        SELECT aid, base, copies, round(c / (len(a) + len(b) - c), 6) AS jaccard, round(c / least(len(a), len(b)), 6) AS containment FROM p WHERE c / (len(a) + len(b) - c) >= 0.5""",
    "block_candidates": f"""WITH {COMPATIBLE}, song AS MATERIALIZED (SELECT title, artist, min(id) AS id FROM track GROUP BY 1, 2), {words_sql('s', 'song', 'id', "concat_ws(' ', title, artist)")}, {words_sql('q', ASKED, 'id', "concat_ws(' ', title, artist)")},
        sw AS (SELECT DISTINCT key AS id, w FROM (SELECT key, unnest(string_split(t, ' ')) AS w FROM s) WHERE length(w) >= 3 AND w NOT IN {BLOCKING}), qw AS (SELECT DISTINCT key AS aid, w FROM (SELECT key, unnest(string_split(t, ' ')) AS w FROM q) WHERE length(w) >= 3 AND w NOT IN {BLOCKING})
        SELECT aid, count(DISTINCT id) AS n FROM qw JOIN sw USING (w) GROUP BY 1""",
    "lookup_texts": rf"""WITH {COMPATIBLE}, {bases_sql('b', 'track')}, f AS (SELECT id, regexp_replace(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', ''), '^[0-9]{{1,3}}[\s._-]+', '') AS f FROM track)
        SELECT t.id, trim(string_split_regex(coalesce(artist, ''), '(?i)\s*(?:,|&| feat\.? | ft\.? | x | vs\.? )\s*')[1] || ' ' || CASE WHEN base = '' THEN coalesce(title, '') ELSE base END) AS query,
            CASE WHEN coalesce(title, '') <> '' OR coalesce(artist, '') <> '' THEN trim(regexp_replace(lower(coalesce(artist, '')), '\s+', ' ', 'g')) || chr(9) || trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g')) ELSE '' END AS unfindable,
            CASE WHEN regexp_matches(f, '^(.*?)\s+[-–—]\s+(.*)$') THEN trim(regexp_extract(f, '^(.*?)\s+[-–—]\s+(.*)$', 1)) ELSE '' END AS file_artist, CASE WHEN regexp_matches(f, '^(.*?)\s+[-–—]\s+(.*)$') THEN trim(regexp_extract(f, '^(.*?)\s+[-–—]\s+(.*)$', 2)) ELSE trim(f) END AS file_title
        FROM track t JOIN b ON b.key = t.id JOIN f USING (id)""",
    "compilations": f"""WITH {COMPATIBLE}, {words_sql('a', 'track', 'id', "coalesce(comment, '')")}, {words_sql('b', 'track', 'id', "coalesce(title, '')")} SELECT id FROM track JOIN a ON a.key = id JOIN b ON b.key = id WHERE regexp_matches(coalesce(comment, ''), '{tx.COMPILATION}') AND a.t <> b.t""",
    "frame_branding": f"""WITH k AS (SELECT source, ({list(FRAMES)})[row_number() OVER (ORDER BY source)] AS key FROM source_target), t AS (SELECT k.key, coalesce(text, '') AS x, regexp_matches(coalesce(text, ''), '{tx.URL_TEXT}') OR regexp_matches(coalesce(text, ''), '{tx.SHOP_TEXT}') AS junk FROM documents d JOIN k USING (source))
        SELECT key, CASE key WHEN 'TALB' THEN CASE WHEN junk THEN 'album' ELSE '' END WHEN 'TIT2' THEN '' WHEN 'TXXX:pool-user' THEN 'brand' WHEN 'WOAF' THEN CASE WHEN trim(x) <> '' THEN 'brand' ELSE '' END WHEN 'publisher' THEN CASE WHEN trim(x) <> '' THEN 'brand' ELSE '' END ELSE CASE WHEN junk THEN 'brand' ELSE '' END END AS kind, count(*) AS n FROM t GROUP BY 1, 2""",
    "already_owned": f"WITH {KEYED}, {KEYED.replace('keyed AS', 'mine AS', 1).replace('FROM track)', 'FROM (SELECT * FROM track_view WHERE id::BIGINT % 50 = 0))')} SELECT m.id, count(*) AS copies FROM mine m JOIN keyed k USING (k_artist, k_base, k_version) WHERE k_base <> '' GROUP BY 1",
    "found_paths": r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '/[A-Za-z]+/[0-9]{4}-[0-9]{2}/')) AS path FROM documents",
    "found_dates": r"SELECT count(*) AS n, count(DISTINCT x) AS days, min(x) AS first, max(x) AS last FROM (SELECT unnest(regexp_extract_all(text, '\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b')) AS x FROM documents)",
}
