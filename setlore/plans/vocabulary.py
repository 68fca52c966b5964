"""Queries over tags, genres and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlore.functions.music import key_moves as move_table
from setlore.functions.music import key_parts, move_rows, normalize_key
from setlore.functions.text import STAGES, comment_energy
from setlore.functions.text import split_genres
from setlore.operators import vocabulary as op
from setlore.plans.affinity import family_sql
from setlore.plans.library import COMMENT, ENERGY, GENRES, KEY_SQL, KEYED, NOTE
from setlore.tables import load

BANK = "Mood"
TIMING = "Moment"


def _view(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track_view")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return _view(s, d).where(F.col("id").cast("bigint") % 50 == 0)


def genre_cloud(s: SparkSession, d: str) -> DataFrame:
    return op.genre_cloud(_view(s, d))


def family_counts(s: SparkSession, d: str) -> DataFrame:
    return op.family_counts(_view(s, d))


def bank_counts_with_zero(s: SparkSession, d: str) -> DataFrame:
    return op.bank_counts(load(s, d, "tag"), _view(s, d))


def styles(s: SparkSession, d: str) -> DataFrame:
    return op.bank_tags(_view(s, d), "Room").groupBy("name").agg(F.count("*").alias("n"))


def directions(s: SparkSession, d: str) -> DataFrame:
    view = _view(s, d)
    first = view.agg(F.min("id").alias("id"))
    return op.directions(view, view.join(F.broadcast(first), "id", "left_semi"), BANK)


def openers(s: SparkSession, d: str) -> DataFrame:
    return op.openers(_view(s, d), TIMING)


def arc_order(s: SparkSession, d: str) -> DataFrame:
    return op.arc_order(load(s, d, "tag"), TIMING)


def genre_split(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").select("id", F.posexplode(split_genres(F.col("genre"))).alias("pos", "name"))


def genre_fix_report(s: SparkSession, d: str) -> DataFrame:
    cloud = op.genre_cloud(_view(s, d))
    return op.fix_report(cloud, op.fixes(cloud))


def genre_catalogue(s: SparkSession, d: str) -> DataFrame:
    cloud = op.genre_cloud(_view(s, d)).select("name", "n")
    table = op.fixes(cloud).select(F.col("wrong").alias("name"), F.col("right").alias("fix_to"))
    return cloud.join(F.broadcast(table), "name", "left").select("name", "n", F.coalesce("fix_to", F.lit("")).alias("fix_to"))


def key_normalise(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "track").select("id", normalize_key(F.col("key")).alias("key"))


def key_moves(s: SparkSession, d: str) -> DataFrame:
    """Pairs of keys in the library's transitions with the move between them and how often it was played."""
    from setlore.plans.affinity import _edges

    keys = _view(s, d).select("id", "key")
    played = _edges(s, d).join(keys.select(F.col("id").alias("src"), F.col("key").alias("k1")), "src").join(keys.select(F.col("id").alias("dst"), F.col("key").alias("k2")), "dst")
    counts = played.where("k1 <> '' and k2 <> ''").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    moves = F.broadcast(move_table(s)).withColumnsRenamed({"src": "k1", "dst": "k2"})
    return counts.join(moves, ["k1", "k2"], "left").select("k1", "k2", "n", "move", "level", "semitones", "notes", "triad")


def compatible_keys(s: SparkSession, d: str) -> DataFrame:
    """Tracks that each key of key_ref can go to, by level of openness."""
    keys = load(s, d, "key_ref").select(F.col("camelot").alias("src"))
    tracks = _view(s, d).groupBy(F.col("key").alias("dst")).agg(F.count("*").alias("n"))
    return keys.join(F.broadcast(move_table(s)), "src").join(tracks, "dst", "left").groupBy("src", "level").agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"))


def bpm_neighbours(s: SparkSession, d: str) -> DataFrame:
    return op.key_neighbours(_asked(s, d), _view(s, d))


def tag_suggest(s: SparkSession, d: str) -> DataFrame:
    return op.suggest_tags(_asked(s, d), _view(s, d), load(s, d, "tag").where("attribute = 0").select("name"))


def comment_energies(s: SparkSession, d: str) -> DataFrame:
    energy, note = comment_energy(F.col("comment"))
    return load(s, d, "track").select("id", energy.alias("energy"), note.alias("note"))


#: Words that tell the group of tags for a kind of night.
KIND_WORDS = ("rave", "after", "sunset", "sunrise", "party", "family", "club", "festival", "lounge", "wedding")
#: A starter vocabulary and an order of tags, as a user may set them.
STARTER = (("mood", "Dark"), ("Mood", "dreamy"), ("Moment", "Warm up"), ("Origin", "Promo"), ("Origin", "Bought"))


def vocabulary_guess(s: SparkSession, d: str) -> DataFrame:
    """Which groups of tags are the mood, the moment and the kind of night."""
    return op.guess_banks(load(s, d, "tag"), KIND_WORDS)


def tag_order(s: SparkSession, d: str) -> DataFrame:
    """The tags of each group in a user's order, here the names that begin with A to F by name, then the rest as it was."""
    tag = load(s, d, "tag")
    groups = tag.where("attribute = 1").select(F.col("id").alias("parent_id"), F.col("name").alias("bank"))
    wanted = tag.where("attribute = 0 and lower(name) < 'g'").join(groups, "parent_id").select("bank", "name", F.col("name").alias("place"))
    return op.ordered_tags(tag, wanted)


def vocabulary_plan(s: SparkSession, d: str) -> DataFrame:
    """What a starter vocabulary would add."""
    return op.vocabulary_plan(load(s, d, "tag"), s.createDataFrame(list(STARTER), "bank string, name string"))


def key_tonics(s: SparkSession, d: str) -> DataFrame:
    """Tonic and mode of every track's key."""
    tonic, mode = key_parts(normalize_key(F.col("key")))
    return load(s, d, "track").select("id", tonic.alias("tonic"), mode.alias("mode"))


def key_agreement(s: SparkSession, d: str) -> DataFrame:
    """How often the view's key is the raw one of the track, where both are known."""
    both = load(s, d, "track").select("id", normalize_key(F.col("key")).alias("raw")).join(_view(s, d).select("id", "key"), "id")
    keyed = (F.col("raw") != "") & (F.coalesce("key", F.lit("")) != "")
    agree = F.sum((keyed & (F.col("raw") == F.col("key"))).cast("long"))
    checked = F.sum(keyed.cast("long"))
    return both.agg(F.count("*").alias("library"), checked.alias("checked"), agree.alias("agree"), F.round(F.try_divide(agree, checked), 6).alias("rate"))


def library_summary(s: SparkSession, d: str) -> DataFrame:
    """The counts that a library's front page shows, as (section, name, n) (M02): groups of tags, genres, families, songs of a minute and more, transitions."""
    view = _view(s, d).where("coalesce(seconds, 0) >= 60")
    part = lambda name, df: df.select(F.lit(name).alias("section"), *df.columns)
    banks = op.bank_counts(load(s, d, "tag"), view).groupBy(F.col("bank").alias("name")).agg(F.sum("n").alias("n"))
    genres, families = op.genre_cloud(view).select("name", "n"), op.family_counts(view).select(F.col("family").alias("name"), "n")
    songs = view.agg(F.count("*").alias("n")).select(F.lit("songs").alias("name"), "n")
    from setlore.plans.affinity import _edges

    ids = view.select("id")
    follows = _edges(s, d).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").agg(F.count("*").alias("n")).select(F.lit("follows").alias("name"), "n")
    return part("banks", banks).unionByName(part("genres", genres)).unionByName(part("families", families)).unionByName(part("total", songs)).unionByName(part("total", follows))


QUERIES = {f.__name__: f for f in (vocabulary_guess, tag_order, vocabulary_plan, key_tonics, key_agreement, library_summary, genre_cloud, family_counts, bank_counts_with_zero, styles, directions, openers, arc_order, genre_split, genre_fix_report, genre_catalogue, key_normalise, key_moves, compatible_keys, bpm_neighbours, tag_suggest, comment_energies)}


def stage_sql(name: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({name}), '{w}')" for w in some) + f" THEN {i}" for i, some in enumerate(STAGES)) + " END"


def _fix_rows() -> str:
    from setlore.functions.text import GENRE_FIXES

    return "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GENRE_FIXES.items()) + ") AS f(wrong, fixed))"


def _moves(columns: str, at: tuple[int, ...]) -> str:
    rows = ", ".join("(" + ", ".join(f"'{r[i]}'" if isinstance(r[i], str) else str(r[i]) for i in at) + ")" for r in move_rows())
    return f"(SELECT * FROM (VALUES {rows}) AS m({columns}))"


CLOUD = "(SELECT g AS name, count(*) AS n FROM (SELECT unnest(genres) AS g FROM track_view) WHERE g <> '' GROUP BY 1)"
BANKED = "(SELECT DISTINCT id, name FROM (SELECT id, unnest(banks['{}']) AS name FROM track_view) WHERE name IS NOT NULL)"
ASKED = "(SELECT * FROM track_view WHERE id::BIGINT % 50 = 0)"
D = "least(abs(a.bpm - b.bpm), abs(a.bpm - b.bpm * 2), abs(a.bpm - b.bpm * 0.5)) / a.bpm"
KIND_ROWS = "(SELECT DISTINCT id, kind FROM (SELECT id, unnest(['g:' || g, 'f:' || {}]) AS kind FROM (SELECT id, unnest(genres) AS g FROM {}) WHERE g <> '') WHERE kind <> 'f:No family')"
ORACLES = {
    "genre_cloud": f"SELECT name, n, {family_sql('name')} AS family FROM {CLOUD}",
    "family_counts": f"SELECT family, count(*) AS n FROM (SELECT DISTINCT id, {family_sql('g')} AS family FROM (SELECT id, unnest(genres) AS g FROM track_view) WHERE g IS NOT NULL) GROUP BY 1",
    "bank_counts_with_zero": """WITH used AS (SELECT DISTINCT id, bank, unnest(banks[bank]) AS name FROM (SELECT id, banks, unnest(map_keys(banks)) AS bank FROM track_view)), c AS (SELECT bank, name, count(*) AS n FROM used WHERE name IS NOT NULL GROUP BY 1, 2)
        SELECT g.name AS bank, t.name, coalesce(c.n, 0) AS n FROM tag t JOIN tag g ON g.id = t.parent_id AND g.attribute = 1 LEFT JOIN c ON c.bank = g.name AND c.name = t.name WHERE t.attribute = 0""",
    "styles": f"SELECT name, count(*) AS n FROM {BANKED.format('Room')} GROUP BY 1",
    "directions": f"SELECT name, n, same FROM (SELECT name, count(*) AS n, name IN (SELECT name FROM {BANKED.format(BANK)} WHERE id = (SELECT min(id) FROM track_view)) AS same FROM {BANKED.format(BANK)} GROUP BY name) ORDER BY same, n DESC, name LIMIT 8",
    "openers": f"""SELECT id, CASE WHEN stage = 0 THEN 0 WHEN stage IS NULL THEN 1 ELSE 2 END AS rank, coalesce(rating, 0) AS rating, coalesce(energy, 9) AS energy
        FROM (SELECT *, list_min(list_transform(coalesce(banks['{TIMING}'], []), lambda x: {stage_sql('x')})) AS stage FROM track_view) ORDER BY 2, 3 DESC, 4, id LIMIT 12""",
    "arc_order": f"SELECT row_number() OVER (ORDER BY coalesce({stage_sql('name')}, 99), seq) AS pos, name, coalesce({stage_sql('name')}, 99) AS stage FROM tag WHERE parent_id = (SELECT id FROM tag WHERE attribute = 1 AND name = '{TIMING}')",
    "genre_split": f"SELECT id, i - 1 AS pos, g[i] AS name FROM (SELECT id, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT id, {GENRES} AS g FROM track))",
    "genre_fix_report": f"""SELECT wrong, fixed AS "right", a.n, coalesce(b.n, 0) AS merges FROM {_fix_rows()} JOIN {CLOUD} a ON a.name = wrong LEFT JOIN {CLOUD} b ON b.name = fixed WHERE wrong <> fixed""",
    "genre_catalogue": f"SELECT name, n, coalesce(fixed, '') AS fix_to FROM {CLOUD} LEFT JOIN {_fix_rows()} ON wrong = name",
    "key_normalise": f"SELECT id, {KEY_SQL} AS key FROM {KEYED}",
    "key_moves": f"""WITH played AS (SELECT a.key AS k1, b.key AS k2, sum(n)::BIGINT AS n FROM EDGES e JOIN track_view a ON a.id = e.src JOIN track_view b ON b.id = e.dst WHERE a.key <> '' AND b.key <> '' GROUP BY 1, 2)
        SELECT k1, k2, n, move, level, semitones, notes, triad FROM played LEFT JOIN {_moves("src, dst, move, level, semitones, notes, triad", (0, 1, 2, 3, 4, 5, 6))} ON src = k1 AND dst = k2""",
    "compatible_keys": f"""SELECT src, level, count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS tracks FROM key_ref JOIN {_moves("src, dst, level", (0, 1, 3))} ON src = camelot LEFT JOIN (SELECT key, count(*) AS n FROM track_view GROUP BY 1) ON key = dst GROUP BY 1, 2""",
    "bpm_neighbours": f"""SELECT id, pos, other, d FROM (SELECT a.id, b.id AS other, round({D}, 9) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round({D}, 9), b.id) AS pos FROM {ASKED} a JOIN track_view b ON a.id <> b.id AND a.bpm > 0 AND b.bpm > 0 AND {D} <= 0.06
        JOIN {_moves("src, dst, level", (0, 1, 3))} ON level = 1 AND src = a.key AND dst = b.key) WHERE pos <= 60""",
    "tag_suggest": f"""WITH pool AS (SELECT * FROM track_view WHERE len(list_filter(tags, lambda x: x IS NOT NULL)) > 0), asked AS {ASKED}, known AS (SELECT DISTINCT name FROM tag WHERE attribute = 0),
        common AS (SELECT a.id, b.id AS other, min(CASE WHEN starts_with(a.kind, 'g:') THEN 0 ELSE 1 END) AS rank FROM {KIND_ROWS.format(family_sql('g'), 'asked')} a JOIN {KIND_ROWS.format(family_sql('g'), 'pool')} b ON a.kind = b.kind AND a.id <> b.id GROUP BY 1, 2),
        far AS (SELECT c.id, c.other, rank, CASE WHEN a.bpm > 0 AND b.bpm > 0 THEN {D} END AS d FROM common c JOIN asked a ON a.id = c.id JOIN pool b ON b.id = c.other),
        alike AS (SELECT id, other FROM far WHERE d IS NULL OR d <= 0.08 QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, round(coalesce(d, 1), 9), other) <= 60),
        carried AS (SELECT s.id, s.other, t.name FROM alike s JOIN (SELECT DISTINCT id AS other, name FROM (SELECT id, unnest(tags) AS name FROM pool) JOIN known USING (name)) t USING (other)),
        sized AS (SELECT id, count(DISTINCT other) AS decided FROM carried JOIN (SELECT id FROM alike GROUP BY 1 HAVING count(*) >= 6) USING (id) GROUP BY 1 HAVING count(DISTINCT other) >= 6),
        counted AS (SELECT id, name, count(*) AS n FROM carried GROUP BY 1, 2)
        SELECT c.id, name, n, round(n / decided, 2) AS share FROM counted c JOIN sized USING (id) JOIN asked a ON a.id = c.id WHERE n / decided >= 0.45 AND NOT coalesce(list_contains(a.tags, name), false) QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY round(n / decided, 2) DESC, name) <= 8""",
    "vocabulary_guess": f"""WITH b AS (SELECT g.name AS bank, g.seq, count(t.id) AS size, count({stage_sql('t.name')}) AS stages, string_agg(lower(t.name), ' ') AS names FROM tag g LEFT JOIN tag t ON t.parent_id = g.id AND t.attribute = 0 WHERE g.attribute = 1 GROUP BY g.id, g.name, g.seq),
        w AS (SELECT *, {' + '.join(f"coalesce(contains(names, '{k}')::INT, 0)" for k in KIND_WORDS)} AS words FROM b),
        timing AS (SELECT coalesce(max(bank), '') AS bank FROM (SELECT bank FROM w WHERE stages >= 2 ORDER BY stages DESC, seq, bank LIMIT 1)),
        mood AS (SELECT coalesce(max(bank), '') AS bank FROM (SELECT bank FROM w WHERE bank <> (SELECT bank FROM timing) ORDER BY size DESC, seq, bank LIMIT 1)),
        rest AS (SELECT * FROM w WHERE bank NOT IN (SELECT bank FROM timing UNION ALL SELECT bank FROM mood))
        SELECT (SELECT bank FROM mood) AS mood, (SELECT bank FROM timing) AS timing, coalesce((SELECT bank FROM rest WHERE words >= 2 ORDER BY words DESC, seq, bank LIMIT 1), (SELECT bank FROM rest ORDER BY size DESC, seq, bank LIMIT 1), '') AS kind""",
    "tag_order": "SELECT g.name AS bank, row_number() OVER (PARTITION BY g.name ORDER BY CASE WHEN lower(t.name) < 'g' THEN t.name END NULLS LAST, t.seq, t.name) AS pos, t.name FROM tag t JOIN tag g ON g.id = t.parent_id AND g.attribute = 1 WHERE t.attribute = 0",
    "vocabulary_plan": f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in STARTER)}) AS v(bank, name))
        SELECT bank, name, EXISTS (SELECT 1 FROM tag g WHERE g.attribute = 1 AND lower(trim(g.name)) = lower(bank)) AS bank_exists, EXISTS (SELECT 1 FROM tag t JOIN tag g ON g.id = t.parent_id WHERE g.attribute = 1 AND lower(trim(g.name)) = lower(bank) AND t.attribute <> 1 AND lower(trim(t.name)) = lower(s.name)) AS "exists" FROM s""",
    "key_tonics": f"SELECT id, CASE WHEN key <> '' THEN ((regexp_extract(key, '^([0-9]+)', 1)::INT - 8) * 7 + CASE WHEN key LIKE '%A' THEN 9 ELSE 0 END + 84) % 12 END AS tonic, CASE WHEN key <> '' THEN CASE WHEN key LIKE '%A' THEN 'minor' ELSE 'major' END END AS mode FROM (SELECT id, {KEY_SQL} AS key FROM {KEYED})",
    "key_agreement": f"""WITH k AS (SELECT r.raw, coalesce(v.key, '') AS key FROM (SELECT id, {KEY_SQL} AS raw FROM {KEYED}) r JOIN track_view v USING (id))
        SELECT count(*) AS library, sum((raw <> '' AND key <> '')::INT)::BIGINT AS checked, sum((raw <> '' AND key <> '' AND raw = key)::INT)::BIGINT AS agree, round(sum((raw <> '' AND key <> '' AND raw = key)::INT) / sum((raw <> '' AND key <> '')::INT), 6) AS rate FROM k""",
    "library_summary": f"""WITH v AS MATERIALIZED (SELECT * FROM track_view WHERE coalesce(seconds, 0) >= 60), g AS (SELECT id, unnest(genres) AS g FROM v)
        SELECT 'banks' AS section, bank AS name, sum(n)::BIGINT AS n FROM (SELECT b.name AS bank, t.name, count(DISTINCT u.id) AS n FROM tag t JOIN tag b ON b.id = t.parent_id AND b.attribute = 1 LEFT JOIN (SELECT id, bank, unnest(banks[bank]) AS name FROM (SELECT id, banks, unnest(map_keys(banks)) AS bank FROM v)) u ON u.bank = b.name AND u.name = t.name WHERE t.attribute = 0 GROUP BY 1, 2) GROUP BY 1, 2
        UNION ALL SELECT 'genres', g, count(*) FROM g WHERE g <> '' GROUP BY 2 UNION ALL SELECT 'families', family, count(*) FROM (SELECT DISTINCT id, {family_sql('g')} AS family FROM g WHERE g IS NOT NULL) GROUP BY 2
        UNION ALL SELECT 'total', 'songs', count(*) FROM v UNION ALL SELECT 'total', 'follows', count(*) FROM EDGES WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)""",
    "comment_energies": f"SELECT id, {ENERGY} AS energy, CASE WHEN {ENERGY} IS NULL THEN {COMMENT} ELSE regexp_replace(regexp_extract({COMMENT}, {NOTE}, 2, 's'), '\\s+$', '', 'g') END AS note FROM track",
}


def _with_edges() -> None:
    from setlore.plans.library import TRANSITIONS

    for name in ("key_moves", "library_summary"):
        ORACLES[name] = ORACLES[name].replace("EDGES", TRANSITIONS)


_with_edges()
