"""Queries over transitions, sets and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setlore.operators import affinity as op
from setlore.operators import library
from setlore.plans.library import PLAYED, TRANSITIONS
from setlore.tables import load

FLOW = ("Mood", "Moment")
KIND = "Room"
MOOD = "Mood"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return library.transitions(library.sessions(load(s, d, "song_history"), load(s, d, "history")))


def _lift(s: SparkSession, d: str) -> DataFrame:
    return op.transition_lift(_edges(s, d), op.tag_pairs(load(s, d, "track_view"), FLOW))


def transition_lift(s: SparkSession, d: str) -> DataFrame:
    return _lift(s, d).withColumn("lift", F.round("lift", 6))


def type_tag_lift(s: SparkSession, d: str) -> DataFrame:
    return op.type_lift(load(s, d, "track_view"), KIND, FLOW).withColumn("lift", F.round("lift", 6))


def lift_compact(s: SparkSession, d: str) -> DataFrame:
    return op.compact(_lift(s, d)).select("tag_a", "tag_b", "lift")


def set_type_weights(s: SparkSession, d: str) -> DataFrame:
    return op.set_weights(load(s, d, "track_view"), KIND).withColumn("weight", F.round("weight", 9))


def _set(s: SparkSession, d: str) -> DataFrame:
    """The set that the fit and suggestion queries continue: the first session's plays, each track once."""
    first = load(s, d, "history").where("deleted = 0").agg(F.min("id").alias("session"))
    plays = library.sessions(load(s, d, "song_history"), load(s, d, "history")).join(F.broadcast(first), "session")
    once = plays.groupBy("content").agg(F.min("trackno").alias("at")).select(F.col("content").alias("id"), "at")
    return once.select(F.row_number().over(Window.orderBy("at", "id")).alias("pos"), "id")


def set_feel(s: SparkSession, d: str) -> DataFrame:
    chosen = load(s, d, "track_view").join(F.broadcast(_set(s, d).select("id")), "id", "left_semi")
    feel = op.set_feel(chosen, MOOD)
    means = feel["means"].select(F.explode(F.array(F.struct(F.lit("energy").alias("name"), F.col("energy").alias("share")), F.struct(F.lit("bpm").alias("name"), F.col("bpm").alias("share")))).alias("m")).select("m.name", "m.share")
    both = feel["moods"].select(F.col("tag").alias("name"), "share").unionByName(feel["families"].select(F.col("family").alias("name"), "share")).unionByName(means)
    return both.withColumn("share", F.round("share", 6))


def feel_fit(s: SparkSession, d: str) -> DataFrame:
    view = load(s, d, "track_view")
    chosen = view.join(F.broadcast(_set(s, d).select("id")), "id", "left_semi")
    return op.feel_fit(view, op.set_feel(chosen, MOOD), MOOD)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    view = load(s, d, "track_view")
    return op.candidates(view, _set(s, d), _lift(s, d), op.type_lift(view, KIND, FLOW), KIND, FLOW)


def candidate_score(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).select("id", F.round("score", 3).alias("score"))


def diverse_pick(s: SparkSession, d: str) -> DataFrame:
    return op.diverse(_candidates(s, d))


QUERIES = {f.__name__: f for f in (transition_lift, type_tag_lift, lift_compact, set_type_weights, set_feel, feel_fit, candidate_score, diverse_pick)}


def _pairs(banks: tuple[str, ...], source: str = "track_view") -> str:
    names = ", ".join(f"'{b}'" for b in banks)
    return f"(SELECT DISTINCT id, bank || '|' || name AS tag FROM (SELECT id, bank, unnest(banks[bank]) AS name FROM (SELECT id, banks, unnest(map_keys(banks)) AS bank FROM {source}) WHERE bank IN ({names})) WHERE name IS NOT NULL)"


LIFT = f"""(SELECT tag_a, tag_b, n, ln(n / (na::DOUBLE * nb / total)) * (n / (n + 8.0)) AS lift FROM (SELECT *, sum(n) OVER (PARTITION BY tag_a) AS na, sum(n) OVER (PARTITION BY tag_b) AS nb, sum(n) OVER () AS total
    FROM (SELECT a.tag AS tag_a, b.tag AS tag_b, sum(e.n)::BIGINT AS n FROM {TRANSITIONS} e JOIN {_pairs(FLOW)} a ON a.id = e.src JOIN {_pairs(FLOW)} b ON b.id = e.dst GROUP BY ALL)))"""
KINDS = f"""(SELECT kind, tag, n, ln(n / (nk::DOUBLE * nt / grand)) * (n / (n + 8.0)) AS lift FROM (SELECT k.tag AS kind, t.tag, count(*) AS n FROM {_pairs((KIND,))} k JOIN {_pairs(FLOW)} t ON t.id = k.id GROUP BY ALL)
    JOIN (SELECT tag AS kind, count(*) AS nk FROM {_pairs((KIND,))} GROUP BY 1) USING (kind) JOIN (SELECT tag, count(*) AS nt FROM {_pairs(FLOW)} GROUP BY 1) USING (tag), (SELECT count(*) AS grand FROM track_view))"""
CHOSEN = f"""(SELECT content AS id, row_number() OVER (ORDER BY min(trackno), content) AS pos FROM {PLAYED} WHERE session = (SELECT min(id) FROM history WHERE deleted = 0) GROUP BY content)"""


def family_sql(name: str) -> str:
    """The SQL twin of functions.text.genre_family."""
    from setlore.functions.text import FAMILIES, NO_FAMILY
    from setlore.plans.library import FOLD

    low = FOLD.format(name)
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({low}, {quoted(w)})' for w in some)} THEN '{label}'" for label, some in FAMILIES) + f" ELSE '{NO_FAMILY}' END"


IN_SET = f"(SELECT * FROM track_view WHERE id IN (SELECT id FROM {CHOSEN}))"
FAMILY_ROWS = "(SELECT DISTINCT id, {case} AS family FROM (SELECT id, unnest(genres) AS g FROM {source}) WHERE g <> '')"
FEEL_CTES = f"""WITH chosen AS MATERIALIZED {IN_SET},
    total AS (SELECT count(*) AS n, avg(energy) AS energy, avg(nullif(bpm, 0)) AS bpm FROM chosen),
    moods AS (SELECT tag, count(*) / any_value(n) AS share FROM {_pairs((MOOD,), "chosen")}, total GROUP BY tag),
    fams AS (SELECT family, count(*) / any_value(n) AS share FROM {FAMILY_ROWS.format(case=family_sql("g"), source="chosen")}, total GROUP BY family)"""

ORACLES = {
    "transition_lift": f"SELECT tag_a, tag_b, n, round(lift, 6) AS lift FROM {LIFT}",
    "type_tag_lift": f"SELECT kind, tag, n, round(lift, 6) AS lift FROM {KINDS}",
    "lift_compact": f"SELECT tag_a, tag_b, round(lift, 4) AS lift FROM {LIFT} WHERE abs(lift) > 0.02",
    "set_type_weights": f"SELECT tag AS kind, round(count(*) / max(count(*)) OVER (), 9) AS weight FROM {_pairs((KIND,))} GROUP BY tag",
    "set_feel": FEEL_CTES + " SELECT tag AS name, round(share, 6) AS share FROM moods UNION ALL SELECT family, round(share, 6) FROM fams UNION ALL SELECT 'energy', round(energy, 6) FROM total UNION ALL SELECT 'bpm', round(bpm, 6) FROM total",
    "feel_fit": FEEL_CTES + f""",
        mood AS (SELECT id, least(1.0, coalesce(sum(share), 0) / any_value((SELECT sum(share) FROM moods))) AS p FROM {_pairs((MOOD,))} LEFT JOIN moods USING (tag) GROUP BY id),
        fam AS (SELECT id, least(1.0, coalesce(sum(share), 0) / any_value((SELECT sum(share) FROM fams))) AS p FROM {FAMILY_ROWS.format(case=family_sql("g"), source="track_view")} LEFT JOIN fams USING (family) GROUP BY id),
        part AS (SELECT v.id, mood.p AS pm, fam.p AS pf, greatest(0.0, 1 - abs(v.energy - total.energy) / 3.0) AS pe, greatest(0.0, 1 - abs(nullif(v.bpm, 0) - total.bpm) / total.bpm / 0.12) AS pb, v.energy AS e, nullif(v.bpm, 0) AS b
            FROM track_view v LEFT JOIN mood ON mood.id = v.id LEFT JOIN fam ON fam.id = v.id, total),
        summed AS (SELECT id, if(pm IS NULL, 0, 0.4) + if(pf IS NULL, 0, 0.25) + if(e IS NULL, 0, 0.2) + if(b IS NULL, 0, 0.15) AS w, if(pm IS NULL, 0, 0.4::DOUBLE * pm) + if(pf IS NULL, 0, 0.25::DOUBLE * pf) + if(e IS NULL, 0, 0.2::DOUBLE * pe) + if(b IS NULL, 0, 0.15::DOUBLE * pb) AS s FROM part)
        SELECT id, CASE WHEN w > 0 THEN round(round(s / w, 9), 3) ELSE 0.5 END AS fit FROM summed""",
    "candidate_score": f"""WITH chosen AS MATERIALIZED {CHOSEN}, lift AS MATERIALIZED (SELECT * FROM {LIFT}), kinds AS MATERIALIZED (SELECT * FROM {KINDS}), tags AS MATERIALIZED (SELECT * FROM {_pairs(FLOW)}),
        moves AS (SELECT * FROM (VALUES MOVE_ROWS) AS m(src, dst, level)),
        near AS (SELECT id, (least(3, n) - back + 1) / least(3, n) AS w FROM (SELECT id, row_number() OVER (ORDER BY pos DESC) AS back, count(*) OVER () AS n FROM chosen) WHERE back <= 3),
        leads AS (SELECT tag AS tag_a, sum(w) AS w FROM tags JOIN near USING (id) GROUP BY 1),
        flow AS (SELECT tag_b AS tag, sum(lift * w) AS flow FROM lift JOIN leads USING (tag_a) GROUP BY 1),
        weights AS (SELECT tag AS kind, count(*) / max(count(*)) OVER () AS weight FROM {_pairs((KIND,))} WHERE id IN (SELECT id FROM chosen) GROUP BY tag),
        party AS (SELECT tag, sum(lift * weight) AS party FROM kinds JOIN weights USING (kind) GROUP BY 1),
        seen AS (SELECT DISTINCT tag FROM tags WHERE id IN (SELECT id FROM chosen)),
        lastone AS (SELECT bpm AS last_bpm, key AS last_key FROM track_view WHERE id = (SELECT id FROM chosen ORDER BY pos DESC LIMIT 1)),
        scored AS (SELECT id, coalesce(sum(flow), 0) / count(*) AS flow, coalesce(sum(party), 0) / count(*) AS party, sum((tag NOT IN (SELECT tag FROM seen))::INT) / count(*) AS fresh
            FROM tags LEFT JOIN flow USING (tag) LEFT JOIN party USING (tag) WHERE id NOT IN (SELECT id FROM chosen) GROUP BY id),
        rated AS (SELECT s.*, v.bpm, last_bpm, level, least(abs(v.bpm - last_bpm), abs(v.bpm * 2 - last_bpm), abs(v.bpm / 2 - last_bpm)) AS gap, coalesce(v.bpm, 0) <> 0 AND coalesce(last_bpm, 0) <> 0 AS both_
            FROM scored s JOIN track_view v ON v.id = s.id CROSS JOIN lastone LEFT JOIN moves ON src = last_key AND dst = v.key)
        SELECT id, round(round((flow + 0.6 * party + 0.5 * fresh + coalesce(0.45 / level, 0)) * CASE WHEN both_ THEN 1 - gap / 14.0 * 0.5 ELSE 1.0 END, 4), 3) AS score FROM rated WHERE NOT both_ OR gap <= 14.0""",
}


def _with_moves() -> None:
    from setlore.functions.music import move_rows

    rows = ", ".join(f"('{r[0]}', '{r[1]}', {r[3]})" for r in move_rows())
    ORACLES["candidate_score"] = ORACLES["candidate_score"].replace("MOVE_ROWS", rows)


_with_moves()
