"""Queries over scores, curves and learned measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlore.operators import learning
from setlore.operators import measures as op
from setlore.operators.signal import chords_of_key
from setlore.tables import load


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Tracks with tempo, tags and a density; the tables hold no waveforms, so plays stand for it."""
    return load(s, d, "track_view").select("id", "bpm", F.col("plays").alias("dens"), F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())).alias("tags"))


def energy_zscore(s: SparkSession, d: str) -> DataFrame:
    return op.anchors(_rows(s, d)).select("id", F.round("anchor", 6).alias("anchor"))


def tag_weights(s: SparkSession, d: str) -> DataFrame:
    return op.tag_weights(op.anchors(_rows(s, d))).select("tag", "n", F.round("weight", 6).alias("weight"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    a = op.anchors(_rows(s, d))
    return op.energy_scores(a, op.tag_weights(a))


def energy_score(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).select("id", F.round("score", 6).alias("score"))


def energy_decile(s: SparkSession, d: str) -> DataFrame:
    return op.deciles(_scores(s, d).select("id", F.round("score", 6).alias("score")))


def order_percentile(s: SparkSession, d: str) -> DataFrame:
    """Place of every track by plays, 0 to 1."""
    plays = load(s, d, "track").select("id", F.coalesce("plays", F.lit(0)).alias("plays"))
    n = plays.agg(F.count("*").alias("n"))
    return op.global_rank(plays, [F.col("plays"), F.col("id")], "i").crossJoin(F.broadcast(n)).select("id", F.round(F.col("i") / F.greatest(F.lit(1), F.col("n") - 1), 9).alias("p"))


def ranked_auc(s: SparkSession, d: str) -> DataFrame:
    """How well plays tell the rated tracks from the others."""
    return op.ranked_auc(load(s, d, "track"), F.coalesce("rating", F.lit(0)) > 0, F.col("plays")).select(F.round("auc", 9).alias("auc"))


def prob_histogram(s: SparkSession, d: str) -> DataFrame:
    """Twenty bins over [0, 1], the last one closed."""
    p = F.least(F.col("energy") / 10.0, F.lit(1.0))
    rows = load(s, d, "track_view").where("energy is not null").select(F.least(F.floor(p * 20), F.lit(19)).alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


def percentiles(s: SparkSession, d: str) -> DataFrame:
    """Exact linear percentiles, median and deviation of the length by format."""
    rows = load(s, d, "track").where("rb_length is not null").groupBy("ext")
    p = lambda x: F.percentile("rb_length", F.lit(x))
    return rows.agg(F.round(p(0.1), 6).alias("p10"), F.round(p(0.5), 6).alias("median"), F.round(p(0.95), 6).alias("p95"), F.round(F.stddev_pop("rb_length"), 6).alias("sd"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("level"), F.col("embedding").cast("array<double>").alias("v"))


def waveform_features(s: SparkSession, d: str) -> DataFrame:
    w = op.waveform(F.col("level"))
    return _vectors(s, d).select("vec_id", F.round(w["dens"], 9).alias("dens"), F.round(w["peak"], 9).alias("peak"))


def smooth_levels(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", F.posexplode(op.moving_average(F.col("level"))).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


def level_contour(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", F.posexplode(op.contour(F.col("level"), 10)).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


def quiet_runs(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", op.quiet_runs(F.col("level"), F.lit(0.1), 2).alias("breaks"))


def _notes() -> Column:
    """The levels of a vector summed by twelve notes in turn."""
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: F.aggregate(F.filter("level", lambda _, i: F.pmod(i, F.lit(12)) == t), F.lit(0.0), lambda a, x: a + x))


def key_finding(s: SparkSession, d: str) -> DataFrame:
    """The key that fits each vector best, its values summed by twelve notes in turn."""
    k = op.find_key(F.col("notes"))
    return _vectors(s, d).withColumn("notes", _notes()).select("vec_id", F.round(k["score"], 6).alias("score"), k["tonic"].alias("tonic"), k["mode"].alias("mode"))


def harmonic_motion(s: SparkSession, d: str) -> DataFrame:
    """Mean cosine distance of consecutive four-value slices of each vector."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("v", (i * 4 + 1).cast("int"), 4))
    rows = _vectors(s, d).withColumn("parts", parts)
    each = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: 1 - op.cosine(F.get("parts", i), F.get("parts", i - 1)))
    return rows.select("vec_id", F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 15, 6).alias("motion"))


def logit_label(s: SparkSession, d: str) -> DataFrame:
    """Probability that a vector has label 0, by a model fitted on all of them."""
    rows = _vectors(s, d).select("vec_id", "v", (F.col("label") == 0).cast("int").alias("y"), F.lit(1.0).alias("w"))
    bias, weights = op.logistic(rows, "v", "y", "w", 3.0)
    return rows.select("vec_id", F.round(op.predicted(rows, "v", bias, weights), 4).alias("p"))


def mode_finding(s: SparkSession, d: str) -> DataFrame:
    """The mode of each vector's notes, tenth parts of them, above its label as the tonic."""
    m = op.find_mode(F.col("notes"), F.pmod("label", F.lit(12)), F.when(F.col("label") % 2 == 0, "minor").otherwise("major"))
    return _vectors(s, d).withColumn("notes", F.transform(_notes(), lambda x: x / 10)).select("vec_id", m["name"].alias("name"), m["mark"].alias("mark"))


def _chords(s: SparkSession, d: str) -> DataFrame:
    """Vectors read as beats: levels of less than 0.02 hold no chord, others one of 24 by their size."""
    beats = F.transform("level", lambda x: F.when(x < 0.02, -1).otherwise(F.pmod(F.floor(x * 40), F.lit(24))).cast("int"))
    return _vectors(s, d).select("vec_id", F.pmod("label", F.lit(12)).alias("tonic"), op.by_bars(beats).alias("bars"))


def bar_chords(s: SparkSession, d: str) -> DataFrame:
    """One chord a bar, by majority of its beats."""
    return _chords(s, d).select("vec_id", F.posexplode("bars").alias("bar", "chord"))


def chord_shares(s: SparkSession, d: str) -> DataFrame:
    """Shares of bars that are minor, on the tonic and outside the minor key, and the changes between them."""
    rows = _chords(s, d).withColumn("real", F.filter("bars", lambda c: c >= 0))
    inside = F.array(*[F.array(*map(F.lit, chords_of_key(t, True))) for t in range(12)])
    outside = op.share_where(F.col("real"), lambda c: ~F.array_contains(F.get(inside, F.col("tonic")), c))
    return rows.select("vec_id", F.round(op.share_where(F.col("real"), lambda c: c % 2 == 1), 9).alias("minor"), F.round(op.share_where(F.col("real"), lambda c: F.floor(c / 2) == F.col("tonic")), 9).alias("on_tonic"), F.round(outside, 9).alias("outside"), F.greatest(F.size(op.collapse(F.col("real"))) - 1, F.lit(0)).alias("changes"))


def chord_timeline(s: SparkSession, d: str) -> DataFrame:
    """The bars at which the chord changes."""
    each = _chords(s, d).select("vec_id", "bars", F.posexplode("bars").alias("bar", "chord"))
    return each.where((F.col("bar") == 0) | (F.col("chord") != F.get("bars", F.col("bar") - 1))).select("vec_id", "bar", "chord")


def chord_loops(s: SparkSession, d: str) -> DataFrame:
    """The bars of each vector as a loop of runs that begins on its tonic."""
    loop = op.from_tonic(op.folded_runs(F.col("bars")), F.col("tonic"))
    return _chords(s, d).select("vec_id", F.array_join(F.transform(loop, lambda r: F.concat_ws("x", r["c"], r["n"])), " ").alias("loop"))


def peak_columns(s: SparkSession, d: str) -> DataFrame:
    """Each vector at ten columns, by their peaks."""
    return _vectors(s, d).select("vec_id", F.posexplode(op.peaks_of(F.col("level"), 10)).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


def onset_shares(s: SparkSession, d: str) -> DataFrame:
    """Where the levels of each vector fall against a beat of eight frames."""
    o = op.onset_places(F.col("level"), 8)
    return _vectors(s, d).select("vec_id", *[F.round(o[n], 9).alias(n) for n in ("on", "off8", "off16")])


def band_shares(s: SparkSession, d: str) -> DataFrame:
    """The shares of the lowest and the highest third of each vector's places in all levels, for bass and tilt."""
    total = lambda test: F.aggregate(F.filter("level", test), F.lit(0.0), lambda a, x: a + x)
    share = lambda test: F.round(F.try_divide(total(test), total(lambda x: x >= 0)), 9)
    return _vectors(s, d).select("vec_id", share(lambda _, i: i < 21).alias("punch"), share(lambda _, i: i >= 43).alias("tilt"))


def prob_over(s: SparkSession, d: str) -> DataFrame:
    """Tracks whose energy, as a share of ten, reaches three bounds."""
    rows = load(s, d, "track_view").where("energy is not null").select((F.col("energy") / 10.0).alias("p"))
    each = F.array(*[F.struct(F.lit(c).alias("bound"), (F.col("p") >= c).cast("long").alias("hit")) for c in (0.5, 0.7, 0.9)])
    return rows.select(F.explode(each).alias("e")).groupBy("e.bound").agg(F.sum("e.hit").alias("n"))


def ranked_library(s: SparkSession, d: str) -> DataFrame:
    """The 300 tracks of most plays and every confirmed one: five stars for yes, one for no; tagged ones need no place of their own."""
    track = load(s, d, "track")
    confirmed = track.where("rating in (1, 5)").select("id", F.when(F.col("rating") == 5, "yes").otherwise("no").alias("mark"))
    tagged = track.where(F.size("mytags") > 0).select("id")
    return learning.ranked_library(track.select("id", F.coalesce("plays", F.lit(0)).alias("p")), confirmed, tagged)


def lesson_verdicts(s: SparkSession, d: str) -> DataFrame:
    """How far a ranking of each format's tracks could be trusted, by made-up scores from their ratings."""
    rated = load(s, d, "track").groupBy("ext").agg(F.sum((F.col("rating") >= 4).cast("long")).alias("yes"), F.sum((F.col("rating") <= 2).cast("long")).alias("no"), F.round(F.avg("rating") / 5, 6).alias("auc"))
    return rated.select("ext", "yes", "no", learning.verdict(F.col("auc"), F.col("yes"), F.col("no"), F.col("no") < 10).alias("verdict"), learning.order_verdict(F.col("auc"), F.col("yes") + F.col("no")).alias("order_verdict"))


def question_pick(s: SparkSession, d: str) -> DataFrame:
    """The next questions after four and after five answers, by energy as a share of ten."""
    p = load(s, d, "track_view").where("energy is not null").select("id", (F.col("energy") / 10.0).alias("p"))
    return learning.next_questions(p, 4).unionByName(learning.next_questions(p, 5))


def question_pair(s: SparkSession, d: str) -> DataFrame:
    """The two tracks to compare next, by plays."""
    return learning.closest_pair(load(s, d, "track").select("id", F.coalesce("plays", F.lit(0)).alias("p")))


QUERIES = {f.__name__: f for f in (question_pick, question_pair, energy_zscore, tag_weights, energy_score, energy_decile, order_percentile, ranked_auc, prob_histogram, percentiles, waveform_features, smooth_levels, level_contour, quiet_runs, key_finding, harmonic_motion, logit_label, mode_finding, bar_chords, chord_shares, chord_timeline, chord_loops, peak_columns, onset_shares, band_shares, prob_over, ranked_library, lesson_verdicts)}

ROWS = "(SELECT id, bpm, plays AS dens, list_distinct(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL)) AS tags FROM track_view)"
ANCHORED = f"""WITH known AS (SELECT id, coalesce(bpm, 0.0) AS bpm, dens::DOUBLE AS dens, tags FROM {ROWS} WHERE dens IS NOT NULL),
    anchored AS (SELECT id, tags, (bpm - avg(bpm) OVER ()) / coalesce(nullif(stddev_pop(bpm) OVER (), 0), 1) * 0.72 + (dens - avg(dens) OVER ()) / coalesce(nullif(stddev_pop(dens) OVER (), 0), 1) * 0.28 AS anchor FROM known),
    weights AS (SELECT tag, avg(anchor) AS weight, count(*) AS n FROM (SELECT anchor, unnest(tags) AS tag FROM anchored) GROUP BY 1 HAVING count(*) >= 25),
    mine AS (SELECT id, avg(weight) AS tagged FROM (SELECT id, unnest(tags) AS tag FROM anchored) JOIN weights USING (tag) GROUP BY 1),
    scored AS (SELECT a.id, CASE WHEN tagged IS NULL THEN anchor ELSE 0.55 * tagged + 0.45 * anchor END AS score FROM anchored a LEFT JOIN mine m ON m.id = a.id)"""
LEVEL = "(SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS level, embedding::DOUBLE[] AS v FROM embeddings)"

NOTES = "list_transform(range(0, 12), lambda t: list_sum(list_transform(range(0, len(level)), lambda i: CASE WHEN i % 12 = t THEN level[i + 1] ELSE 0 END)))"
BEATS = f"(SELECT vec_id, label % 12 AS tonic, i // 4 AS bar, CASE WHEN x < 0.02 THEN -1 ELSE floor(x * 40)::INT % 24 END AS c FROM (SELECT vec_id, label, unnest(range(len(level))) AS i, unnest(level) AS x FROM {LEVEL}))"
BARS = f"(SELECT vec_id, tonic, bar::INT AS bar, coalesce(min_by(c, -n * 100 + c) FILTER (WHERE c >= 0), -1)::INT AS chord FROM (SELECT vec_id, tonic, bar, c, count(*) AS n FROM {BEATS} GROUP BY ALL) GROUP BY vec_id, tonic, bar)"


def _key_sql() -> str:
    rows = []
    for mode, profile, lead in (("major", op.MAJOR, 0.0), ("minor", op.MINOR, op.MINOR_LEAD)):
        mean = sum(profile) / 12
        rows.append(f"('{mode}', {[x - mean for x in profile]}, {sum((x - mean) ** 2 for x in profile)!r}::DOUBLE, {lead})")
    return f"""WITH n AS (SELECT vec_id, {NOTES} AS l FROM {LEVEL}), p AS (SELECT vec_id, l, list_avg(l) AS m FROM n), profile AS (SELECT * FROM (VALUES {', '.join(rows)}) AS x(mode, w, norm, lead)),
        r AS (SELECT vec_id, mode, tonic, round(list_sum(list_transform(range(1, 13), lambda i: l[((i - 1 + tonic) % 12 + 1)::INT] * w[i]::DOUBLE)) / sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) * norm) + lead, 9) AS score FROM p, profile, (SELECT unnest(range(12))::INT AS tonic))
        SELECT vec_id, round(score, 6) AS score, tonic, mode FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, tonic DESC, mode DESC) = 1"""


ORACLES = {
    "energy_zscore": ANCHORED + " SELECT id, round(anchor, 6) AS anchor FROM anchored",
    "tag_weights": ANCHORED + " SELECT tag, n, round(weight, 6) AS weight FROM weights",
    "energy_score": ANCHORED + " SELECT id, round(score, 6) AS score FROM scored",
    "energy_decile": ANCHORED + " SELECT id, least(10, 1 + (10 * (row_number() OVER (ORDER BY round(score, 6), id) - 1)) // count(*) OVER ())::INT AS decile FROM scored",
    "order_percentile": "SELECT id, round((row_number() OVER (ORDER BY coalesce(plays, 0), id) - 1) / greatest(1, count(*) OVER () - 1), 9) AS p FROM track",
    "ranked_auc": """WITH r AS (SELECT (coalesce(rating, 0) > 0)::INT AS y, rank() OVER (ORDER BY plays) + (count(*) OVER (PARTITION BY plays) - 1) / 2.0 AS r FROM track WHERE plays IS NOT NULL)
        SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)), 9) AS auc FROM r""",
    "prob_histogram": "SELECT least(floor(least(energy / 10.0, 1.0) * 20), 19)::BIGINT AS bin, count(*) AS n FROM track_view WHERE energy IS NOT NULL GROUP BY 1",
    "percentiles": "SELECT ext, round(quantile_cont(rb_length, 0.1), 6) AS p10, round(quantile_cont(rb_length, 0.5), 6) AS median, round(quantile_cont(rb_length, 0.95), 6) AS p95, round(stddev_pop(rb_length), 6) AS sd FROM track WHERE rb_length IS NOT NULL GROUP BY 1",
    "waveform_features": f"SELECT vec_id, round(len(list_filter(level, lambda x: x > peak * 0.75)) / len(level), 9) AS dens, round(peak, 9) AS peak FROM (SELECT *, list_sort(level)[floor(len(level) * 0.95)::INT + 1] AS peak FROM {LEVEL})",
    "smooth_levels": f"SELECT vec_id, i, round(list_sum(list_transform(range(greatest(0, i - 5), least(len(level), i + 6)), lambda j: level[j + 1])) / 11, 9) AS x FROM (SELECT *, unnest(range(len(level)))::INT AS i FROM {LEVEL})",
    "level_contour": f"SELECT vec_id, (j * 10 // n)::INT AS i, round(avg(x), 9) AS x FROM (SELECT vec_id, len(level) AS n, unnest(level) AS x, unnest(range(len(level))) AS j FROM {LEVEL}) GROUP BY 1, 2",
    "quiet_runs": f"""WITH x AS (SELECT vec_id, j, q, len(level) AS n FROM (SELECT vec_id, level, unnest(range(len(level))) AS j, unnest(level) < 0.1 AS q FROM {LEVEL})), g AS (SELECT *, j - row_number() OVER (PARTITION BY vec_id, q ORDER BY j) AS island FROM x),
        run AS (SELECT vec_id, island, count(*) AS c, max(j) AS last, any_value(n) AS n FROM g WHERE q GROUP BY 1, 2) SELECT e.vec_id, count(r.c)::INT AS breaks FROM embeddings e LEFT JOIN run r ON r.vec_id = e.vec_id AND r.c >= 2 AND r.last < r.n - 1 GROUP BY 1""",
    "key_finding": _key_sql(),
    "harmonic_motion": f"""WITH p AS (SELECT vec_id, i, v[i * 4 + 1 : i * 4 + 4] AS a, v[i * 4 - 3 : i * 4] AS b FROM (SELECT vec_id, v, unnest(range(1, 16)) AS i FROM {LEVEL})) SELECT vec_id, round(sum(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))) / 15, 6) AS motion FROM p GROUP BY 1""",
    "mode_finding": f"""WITH n AS (SELECT vec_id, label, list_transform({NOTES}, lambda x: x / 10) AS l FROM {LEVEL}), r AS (SELECT vec_id, label, list_transform(range(12), lambda k: l[((k + label) % 12 + 1)::INT]) AS r FROM n),
        z AS (SELECT vec_id, unnest(CASE WHEN label % 2 = 0 THEN [{{'p': 0, 'name': 'Phrygian', 'z': (r[2] - r[3] + 0.0336) / 0.0259}}, {{'p': 1, 'name': 'Dorian', 'z': -(r[9] - r[10] + 0.0003) / 0.0198}}, {{'p': 2, 'name': 'Harmonic minor', 'z': -(r[11] - r[12] - 0.0234) / 0.0242}}]
            ELSE [{{'p': 0, 'name': 'Mixolydian', 'z': (r[11] - r[12] + 0.0130) / 0.0313}}, {{'p': 1, 'name': 'Lydian', 'z': (r[7] - r[6] + 0.0114) / 0.0267}}] END) AS m, label FROM r)
        SELECT vec_id, CASE WHEN m.z >= 1.25 THEN m.name WHEN label % 2 = 0 THEN 'Aeolian' ELSE 'Ionian' END AS name, round(m.z::DOUBLE, 2) AS mark FROM z QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY m.z DESC, m.p) = 1""",
    "bar_chords": f"SELECT vec_id, bar, chord FROM {BARS}",
    "chord_shares": f"""WITH b AS (SELECT *, lag(chord) OVER (PARTITION BY vec_id ORDER BY bar) AS before, chord // 2 AS root, CASE WHEN chord % 2 = 1 THEN 3 ELSE 4 END AS third FROM {BARS} WHERE chord >= 0),
        o AS (SELECT *, NOT ((list_contains([0, 2, 3, 5, 7, 8, 10], (root - tonic + 12) % 12) AND list_contains([0, 2, 3, 5, 7, 8, 10], (root + third - tonic + 12) % 12) AND list_contains([0, 2, 3, 5, 7, 8, 10], (root + 7 - tonic + 12) % 12)) OR (third = 4 AND root = (tonic + 7) % 12)) AS outside FROM b)
        SELECT e.vec_id, coalesce(round(avg((third = 3)::INT), 9), 0) AS minor, coalesce(round(avg((root = tonic)::INT), 9), 0) AS on_tonic, coalesce(round(avg(outside::INT), 9), 0) AS outside, count(*) FILTER (WHERE before <> chord)::INT AS changes FROM embeddings e LEFT JOIN o ON o.vec_id = e.vec_id GROUP BY 1""",
    "chord_timeline": f"SELECT vec_id, bar, chord FROM {BARS} QUALIFY lag(chord) OVER (PARTITION BY vec_id ORDER BY bar) IS DISTINCT FROM chord",
    "chord_loops": f"""WITH g AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY bar) AS run FROM (SELECT *, (lag(chord) OVER (PARTITION BY vec_id ORDER BY bar) IS DISTINCT FROM chord)::INT AS new FROM {BARS})),
        r AS (SELECT vec_id, any_value(tonic) AS tonic, run, any_value(chord) AS c, count(*) AS n FROM g GROUP BY vec_id, run), e AS (SELECT *, max(run) OVER (PARTITION BY vec_id) AS last, first_value(c) OVER (PARTITION BY vec_id ORDER BY run) AS c1, last_value(c) OVER (PARTITION BY vec_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cn, last_value(n) OVER (PARTITION BY vec_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nn FROM r),
        w AS (SELECT vec_id, tonic, run, c, CASE WHEN last > 1 AND c1 = cn AND run = 1 THEN n + nn ELSE n END AS n FROM e WHERE NOT (last > 1 AND c1 = cn AND run = last)),
        s AS (SELECT *, coalesce(min(CASE WHEN c >= 0 AND c // 2 = tonic THEN run END) OVER (PARTITION BY vec_id), min_by(run, -n * 1000 + run) OVER (PARTITION BY vec_id)) AS start FROM w)
        SELECT vec_id, string_agg(c || 'x' || n, ' ' ORDER BY run < start, run) AS loop FROM s GROUP BY 1""",
    "peak_columns": f"SELECT vec_id, i::INT AS i, round(list_max(level[(i * len(level) // 10 + 1):greatest((i + 1) * len(level) // 10, i * len(level) // 10 + 1)]), 9) AS x FROM (SELECT *, unnest(range(10)) AS i FROM {LEVEL})",
    "onset_shares": f"""WITH x AS (SELECT vec_id, x, (j % 8) / 8.0 AS p FROM (SELECT vec_id, unnest(range(len(level))) AS j, unnest(level) AS x FROM {LEVEL})), t AS (SELECT vec_id, coalesce(sum(x) FILTER (WHERE p < 0.1 OR p > 0.9), 0) AS a, coalesce(sum(x) FILTER (WHERE abs(p - 0.5) < 0.1), 0) AS b, coalesce(sum(x) FILTER (WHERE abs(p - 0.25) < 0.08 OR abs(p - 0.75) < 0.08), 0) AS c FROM x GROUP BY 1)
        SELECT vec_id, round(a / h, 9) AS "on", round(b / h, 9) AS off8, round(c / h, 9) AS off16 FROM (SELECT *, CASE WHEN a + b + c = 0 THEN 1 ELSE a + b + c END AS h FROM t)""",
    "band_shares": f"SELECT vec_id, round(list_sum(level[1:21]) / list_sum(level), 9) AS punch, round(list_sum(level[44:]) / list_sum(level), 9) AS tilt FROM {LEVEL}",
    "prob_over": "SELECT bound::DOUBLE AS bound, count(*) FILTER (WHERE energy / 10.0 >= bound) AS n FROM track_view, (SELECT unnest([0.5, 0.7, 0.9]) AS bound) WHERE energy IS NOT NULL GROUP BY 1",
    "ranked_library": """WITH t AS (SELECT id, coalesce(plays, 0) AS p, CASE rating WHEN 5 THEN 'yes' WHEN 1 THEN 'no' END AS mark, len(coalesce(mytags, [])) > 0 AS tagged FROM track)
        SELECT id, p, mark FROM t QUALIFY row_number() OVER (ORDER BY p DESC, id) <= 300 OR (coalesce(mark, '') = 'yes' AND NOT tagged)""",
    "lesson_verdicts": """WITH r AS (SELECT ext, sum((rating >= 4)::INT)::BIGINT AS yes, sum((rating <= 2)::INT)::BIGINT AS no, round(avg(rating) / 5, 6) AS auc FROM track GROUP BY 1)
        SELECT ext, yes, no, CASE WHEN auc IS NULL THEN 'too-few' WHEN no < 10 THEN CASE WHEN auc >= 0.8 THEN 'useful' ELSE 'rough' END WHEN least(yes, no) < 10 THEN 'early' WHEN auc >= 0.9 THEN 'strong' WHEN auc >= 0.8 THEN 'useful' WHEN auc >= 0.7 THEN 'rough' ELSE 'weak' END AS verdict,
            CASE WHEN auc IS NULL THEN 'too-few' WHEN yes + no < 15 THEN 'early' WHEN auc >= 0.8 THEN 'strong' WHEN auc >= 0.65 THEN 'useful' ELSE 'weak' END AS order_verdict FROM r""",
    "question_pick": """WITH p AS (SELECT id, energy / 10.0::DOUBLE AS p FROM track_view WHERE energy IS NOT NULL), n AS (SELECT * FROM p ORDER BY abs(p - 0.5), id LIMIT 10)
        SELECT * FROM (SELECT * FROM n ORDER BY md5(id), id LIMIT 1) UNION ALL SELECT * FROM (SELECT * FROM p ORDER BY p DESC, id LIMIT 1)""",
    "question_pair": """WITH d AS (SELECT id, coalesce(plays, 0) AS p FROM track ORDER BY md5(id), id LIMIT 200)
        SELECT * FROM (SELECT lag(id) OVER w AS low, id AS high, p - lag(p) OVER w AS gap FROM d WINDOW w AS (ORDER BY p, id)) WHERE low IS NOT NULL ORDER BY gap, low LIMIT 1""",
}
