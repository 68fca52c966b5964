"""Measures over columns and arrays: scores, deciles, ranks, curves, runs, profiles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.session import materialise

# Shares of the anchor and of the tags in an energy score, and the least tracks of a tag.
ANCHOR = {"bpm": 0.72, "dens": 0.28}
TAG_SHARE = 0.55
MIN_TAG = 25
# Learned profiles of the twelve notes above the tonic, and the lead of minor.
MAJOR = (1.000, 0.534, 0.836, 0.531, 0.953, 0.649, 0.553, 0.984, 0.470, 0.690, 0.580, 0.690)
MINOR = (1.000, 0.496, 0.764, 0.722, 0.636, 0.660, 0.460, 0.970, 0.529, 0.532, 0.704, 0.517)
MINOR_LEAD = 0.10


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z_<column>: deviation from the mean in population standard deviations (a deviation of 0 counts as 1).

    The moments are one aggregate row, broadcast; no window gathers the table.
    """
    moments = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}"))])
    out = df.crossJoin(F.broadcast(moments))
    return out.select(*df.columns, *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{c}") for c in columns])


def anchors(df: DataFrame) -> DataFrame:
    """(id, tags, anchor) of (id, bpm, dens, tags); rows without density are left out, a missing tempo is 0."""
    known = df.where("dens is not null").select("id", F.coalesce(F.col("bpm").cast("double"), F.lit(0.0)).alias("bpm"), F.col("dens").cast("double").alias("dens"), "tags")
    return zscore(known, ["bpm", "dens"]).select("id", "tags", (F.col("z_bpm") * ANCHOR["bpm"] + F.col("z_dens") * ANCHOR["dens"]).alias("anchor"))


def tag_weights(anchored: DataFrame, least: int = MIN_TAG) -> DataFrame:
    each = anchored.select("anchor", F.explode("tags").alias("tag")).where("tag is not null")
    return each.groupBy("tag").agg(F.avg("anchor").alias("weight"), F.count("*").alias("n")).where(F.col("n") >= least)


def energy_scores(anchored: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, score): tags' mean weight mixed with the anchor; the anchor alone where no tag has a weight."""
    mine = anchored.select("id", F.explode("tags").alias("tag")).join(weights.select("tag", "weight"), "tag").groupBy("id").agg(F.avg("weight").alias("tagged"))
    return anchored.join(mine, "id", "left").select("id", F.when(F.col("tagged").isNull(), F.col("anchor")).otherwise(TAG_SHARE * F.col("tagged") + (1 - TAG_SHARE) * F.col("anchor")).alias("score"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its 0-based place in a total order, without gathering it in one partition.

    Rows are range-partitioned by the order, sorted and stored once with the place inside their partition; the
    partitions' sizes, one row each, are added up and joined back. Nothing is partitioned twice.
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"))
    before = sizes.select("part_", F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return placed.withColumn("part_", part).join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).drop("part_", "at_", "before_")


def deciles(scored: DataFrame) -> DataFrame:
    """(id, decile): min(10, 1 + floor(10 i / n)) over the 0-based place i by score; ties by id."""
    ranked = global_rank(scored, [F.round("score", 9), F.col("id")], "i")
    n = scored.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(n)).select("id", F.least(F.lit(10), 1 + F.floor(10 * F.col("i") / F.col("n"))).cast("int").alias("decile"))


def ranked_auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """(auc): the probability that a random yes scores above a random no, ties half; null if a class is empty.

    Distinct scores are counted and range-partitioned; each partition adds up its own pairs and reports one
    row, and only these rows meet in one window.
    """
    counts = df.select(score.cast("double").alias("s"), label.cast("int").alias("y")).where("s is not null and y is not null").groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        low, pos, neg, pairs = None, 0, 0, 0.0
        for batch in batches:
            if batch.num_rows:
                p, n = batch["pos"].to_numpy().astype(float), batch["neg"].to_numpy().astype(float)
                low = batch["s"][0].as_py() if low is None else low
                pairs += float((p * (neg + n.cumsum() - n / 2)).sum())
                pos, neg = pos + int(p.sum()), neg + int(n.sum())
        if low is not None:
            yield pa.RecordBatch.from_pydict({"low": [low], "pos": [pos], "neg": [neg], "pairs": [pairs]})

    parts = counts.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(add_up, "low double, pos long, neg long, pairs double")
    below = F.coalesce(F.sum("neg").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.withColumn("below", below).agg(F.sum(F.col("pairs") + F.col("pos") * F.col("below")).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.try_divide("u", F.col("p").cast("double") * F.col("n")).alias("auc"))


def waveform(total: Column) -> Column:
    """struct(dens, peak) of an array of levels: the share above 0.75 of the nearest-rank 95th percentile; null if empty or silent."""
    n = F.size(total)
    peak = F.element_at(F.array_sort(total), (F.floor(n * 0.95) + 1).cast("int"))
    safe = F.when(peak == 0, 1.0).otherwise(peak)
    ok = (n > 0) & (F.aggregate(total, F.lit(0.0), lambda a, x: a + x) > 0)
    return F.when(ok, F.struct((F.size(F.filter(total, lambda x: x > safe * 0.75)) / n).alias("dens"), safe.alias("peak")))


def moving_average(values: Column, half: int = 5) -> Column:
    """Mean over 2 half + 1 places, the ends padded with zeros."""
    width = 2 * half + 1
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, F.greatest(i - half + 1, F.lit(1)).cast("int"), (F.least(i + half, F.size(values) - 1) - F.greatest(i - half, F.lit(0)) + 1).cast("int")), F.lit(0.0), lambda a, x: a + x) / width)


def contour(values: Column, points: int = 32) -> Column:
    """Means of `points` equal segments; segment p holds the places i with floor(i * points / n) = p."""
    n = F.size(values)
    cut = lambda p: F.ceil(p * n / F.lit(float(points))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda p: F.try_divide(F.aggregate(F.slice(values, cut(p) + 1, F.greatest(cut(p + 1) - cut(p), F.lit(0))), F.lit(0.0), lambda a, x: a + x), (cut(p + 1) - cut(p)).cast("double")))


def quiet_runs(values: Column, floor: Column, least: int) -> Column:
    """How many runs of values under a floor last at least `least` places; a run still open at the end does not count."""
    step = lambda a, x: F.when(x < floor, F.struct((a["run"] + 1).alias("run"), a["n"].alias("n"))).otherwise(F.struct(F.lit(0).alias("run"), (a["n"] + F.when(a["run"] >= least, 1).otherwise(0)).alias("n")))
    return F.aggregate(values, F.struct(F.lit(0).alias("run"), F.lit(0).alias("n")), step)["n"]


def collapse(values: Column) -> Column:
    """Consecutive equal entries as one."""
    return F.filter(F.transform(values, lambda x, i: F.when((i == 0) | (x != F.get(values, i - 1)), x)), lambda x: x.isNotNull())


def correlations(profile: Column, template: tuple[float, ...]) -> Column:
    """Correlation of a fixed profile with the array turned left by 0, 1, ... len - 1 places; 0 where nothing varies."""
    size = len(template)
    mean = sum(template) / size
    centred = F.array(*[F.lit(x - mean) for x in template])
    norm = sum((x - mean) ** 2 for x in template)
    average = F.aggregate(profile, F.lit(0.0), lambda s, x: s + x) / size
    below = F.sqrt(F.aggregate(profile, F.lit(0.0), lambda s, x: s + (x - average) * (x - average)) * norm)
    dot = lambda t: F.aggregate(F.zip_with(F.concat(F.slice(profile, t + 1, F.lit(size) - t), F.slice(profile, F.lit(1), t)), centred, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda t: F.coalesce(F.try_divide(dot(t), below), F.lit(0.0)))


def find_key(profile: Column) -> Column:
    """struct(score, tonic, mode) of the best of 24 keys for a profile of twelve notes from C; minor has a lead."""
    def options(mode: str, template: tuple[float, ...], lead: float) -> Column:
        return F.transform(correlations(profile, template), lambda c, t: F.struct(F.round(c + lead, 9).alias("score"), t.alias("tonic"), F.lit(mode).alias("mode")))

    return F.array_max(F.concat(options("major", MAJOR, 0.0), options("minor", MINOR, MINOR_LEAD)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def logistic(df: DataFrame, features: str, label: str, weight: str, penalty: float) -> tuple[float, list[float]]:
    """(bias, weights) of the L2-penalised logistic regression: sum of weighted losses plus penalty/2 times the squared weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    total = rows.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(weightCol="weight", regParam=penalty / total, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    return float(model.intercept), [float(x) for x in model.coefficients]


def predicted(df: DataFrame, features: str, bias: float, weights: list[float]) -> Column:
    z = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) + bias
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


# Mean and spread of the contrasts that tell modes apart, and how marked one must be.
MODE_CONTRAST = {"minor": {"b2": (-0.0336, 0.0259), "b6": (-0.0003, 0.0198), "b7": (0.0234, 0.0242)}, "major": {"b7": (-0.0130, 0.0313), "#4": (-0.0114, 0.0267)}}
MODE_MARK = 1.25
# The mode that each contrast names, by its sign.
MODE_NAMES = {"minor": (("Phrygian", "b2", 1), ("Dorian", "b6", -1), ("Harmonic minor", "b7", -1)), "major": (("Mixolydian", "b7", 1), ("Lydian", "#4", 1))}
PLAIN_MODES = {"minor": "Aeolian", "major": "Ionian"}
# The notes between which each contrast lies, counted from the tonic.
CONTRAST_NOTES = {"b2": (1, 2), "b6": (8, 9), "b7": (10, 11), "#4": (6, 5)}


def find_mode(profile: Column, tonic: Column, mode: Column) -> Column:
    """struct(name, mark) of the mode of a profile of twelve notes from C, given tonic and 'major' or 'minor'; of equal marks the first listed."""
    note = lambda n: F.get(profile, F.pmod(tonic + n, F.lit(12)).cast("int"))

    def of(key: str) -> Column:
        marks = []
        for place, (name, contrast, sign) in enumerate(MODE_NAMES[key]):
            mean, spread = MODE_CONTRAST[key][contrast]
            high, low = CONTRAST_NOTES[contrast]
            marks.append(F.struct(((note(high) - note(low) - mean) / spread * sign).alias("mark"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
        best = F.array_max(F.array(*marks))
        return F.struct(F.when(best["mark"] >= MODE_MARK, best["name"]).otherwise(PLAIN_MODES[key]).alias("name"), F.round(best["mark"], 2).alias("mark"))

    return F.when(mode == "minor", of("minor")).otherwise(of("major"))


def commonest(values: Column) -> Column:
    """The commonest value of an array that is not negative, of ties the smallest; -1 if there is none."""
    real = F.filter(values, lambda x: x >= 0)
    counted = F.transform(F.array_distinct(real), lambda v: F.struct(F.size(F.filter(real, lambda x: x == v)).alias("n"), (-v).alias("v")))
    return F.coalesce(-F.array_max(counted)["v"], F.lit(-1))


def by_bars(values: Column, size: int = 4) -> Column:
    """The commonest value of each whole group of `size` (one chord a bar)."""
    return F.when(F.size(values) >= size, F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / size).cast("int") - 1), lambda i: commonest(F.slice(values, i * size + 1, size)))).otherwise(F.array().cast("array<int>"))


def folded_runs(pattern: Column) -> Column:
    """array<struct<c, n>>: runs of equal values of a loop, the last run joined to the first if they are equal."""
    empty = F.array().cast("array<struct<c:int,n:int>>")

    def step(runs: Column, c: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        one = lambda n: F.array(F.struct(c.cast("int").alias("c"), n.cast("int").alias("n")))
        return F.when(F.coalesce(last["c"] == c, F.lit(False)), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), one(last["n"] + 1))).otherwise(F.concat(runs, one(F.lit(1))))

    runs = F.aggregate(pattern, empty, step)
    first, last = F.get(runs, F.lit(0)), F.get(runs, F.size(runs) - 1)
    wraps = (F.size(runs) > 1) & (first["c"] == last["c"])
    joined = F.concat(F.array(F.struct(first["c"].alias("c"), (first["n"] + last["n"]).cast("int").alias("n"))), F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 2, F.lit(0))))
    return F.when(wraps, joined).otherwise(runs)


def from_tonic(runs: Column, tonic: Column) -> Column:
    """A loop of runs (c is twice the root, one more for minor) turned to begin on the tonic, else on its longest run, of ties the first."""
    place = lambda test: F.array_position(F.transform(runs, test), True).cast("int")
    home = place(lambda r: F.floor(r["c"] / 2) == tonic)
    longest = place(lambda r: r["n"] == F.array_max(F.transform(runs, lambda q: q["n"])))
    at = F.when(home > 0, home).otherwise(longest)
    return F.when(F.size(runs) > 0, F.concat(F.slice(runs, at, F.size(runs) - at + 1), F.slice(runs, F.lit(1), at - 1))).otherwise(runs)


def share_where(values: Column, test) -> Column:
    """The share of an array's values that pass a test, 0 of none."""
    return F.coalesce(F.try_divide(F.size(F.filter(values, test)).cast("double"), F.size(values)), F.lit(0.0))


def peaks_of(values: Column, columns: int) -> Column:
    """The greatest value of each of `columns` slices, a slice holding one value at least."""
    n = F.size(values)
    low = lambda i: F.floor(i * n / F.lit(columns)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.array_max(F.slice(values, low(i) + 1, F.greatest(low(i + 1) - low(i), F.lit(1))))))


def onset_places(strength: Column, beat: int) -> Column:
    """struct(on, off8, off16): shares of an onset curve on the beat, halfway and at the quarters, with `beat` frames a beat; 0 where nothing sounds."""
    placed = F.transform(strength, lambda x, i: F.struct(x.alias("x"), (F.pmod(i, F.lit(beat)) / F.lit(float(beat))).alias("p")))
    total = lambda test: F.aggregate(F.filter(placed, test), F.lit(0.0), lambda s, v: s + v["x"])
    on = total(lambda v: (v["p"] < 0.1) | (v["p"] > 0.9))
    half = total(lambda v: F.abs(v["p"] - 0.5) < 0.1)
    quarter = total(lambda v: (F.abs(v["p"] - 0.25) < 0.08) | (F.abs(v["p"] - 0.75) < 0.08))
    hit = F.when(on + half + quarter == 0, 1.0).otherwise(on + half + quarter)
    return F.struct((on / hit).alias("on"), (half / hit).alias("off8"), (quarter / hit).alias("off16"))
