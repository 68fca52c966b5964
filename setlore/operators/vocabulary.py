"""Tags, genres and keys as vocabularies: counts, families, directions, openers, neighbours, suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.functions.music import bpm_distance, key_moves
from setlore.functions.text import GENRE_FIXES, NO_FAMILY, arc_stage, genre_family
from setlore.session import materialise

#: Width of a tempo bucket, as a natural logarithm.
BUCKET = 0.04


def genre_cloud(view: DataFrame) -> DataFrame:
    counts = view.select(F.explode("genres").alias("name")).where("name is not null and name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    return counts.withColumn("family", genre_family(F.col("name")))


def family_counts(view: DataFrame) -> DataFrame:
    each = view.select("id", F.explode("genres").alias("g")).where("g is not null").select("id", genre_family(F.col("g")).alias("family")).distinct()
    return each.groupBy("family").agg(F.count("*").alias("n"))


def bank_counts(tag: DataFrame, view: DataFrame) -> DataFrame:
    """(bank, name, n): tracks by tag, tags without tracks included."""
    groups = tag.where("attribute = 1").select(F.col("id").alias("parent_id"), F.col("name").alias("bank"))
    known = tag.where("attribute = 0").select("name", "parent_id").join(groups, "parent_id").select("bank", "name")
    used = view.select("id", F.explode("banks").alias("bank", "names")).select("id", "bank", F.explode("names").alias("name")).where("name is not null").distinct().groupBy("bank", "name").agg(F.count("*").alias("n"))
    return known.join(used, ["bank", "name"], "left").select("bank", "name", F.coalesce("n", F.lit(0)).alias("n"))


def bank_tags(view: DataFrame, bank: str) -> DataFrame:
    return view.select("id", F.explode(F.col("banks")[bank]).alias("name")).where("name is not null").distinct()


def directions(view: DataFrame, ref: DataFrame, bank: str, top: int = 8) -> DataFrame:
    """(name, n, same): tags of a group in a pool, those the reference track lacks first; the top of the list."""
    have = bank_tags(ref, bank).select("name").withColumn("same", F.lit(True))
    counts = bank_tags(view, bank).groupBy("name").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(have), "name", "left").select("name", "n", F.coalesce("same", F.lit(False)).alias("same")).orderBy("same", F.desc("n"), "name").limit(top)


def openers(view: DataFrame, timing: str, limit: int = 12) -> DataFrame:
    """Tracks to begin with: tagged as opening first, untagged next; then rating, energy and id."""
    stage = F.array_min(F.transform(F.coalesce(F.col("banks")[timing], F.array().cast("array<string>")), arc_stage))
    rank = F.when(stage == 0, 0).when(stage.isNull(), 1).otherwise(2)
    rows = view.select("id", rank.alias("rank"), F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("energy", F.lit(9)).alias("energy"))
    return rows.orderBy("rank", F.desc("rating"), "energy", "id").limit(limit)


def arc_order(tag: DataFrame, bank: str) -> DataFrame:
    """(pos, name): a group's tags in the order of a night; those that no word places keep their order after the rest."""
    group = tag.where((F.col("attribute") == 1) & (F.col("name") == bank)).select(F.col("id").alias("parent_id"))
    rows = tag.join(F.broadcast(group), "parent_id", "left_semi").select("name", "seq", F.coalesce(arc_stage(F.col("name")), F.lit(99)).alias("stage"))
    return rows.select(F.row_number().over(Window.orderBy("stage", "seq")).alias("pos"), "name", "stage")


def fixes(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(GENRE_FIXES.items()), "wrong string, right string")


def fix_report(cloud: DataFrame, table: DataFrame) -> DataFrame:
    """(wrong, right, n, merges): spellings to put right that occur, and how many rows have the right one already."""
    n = cloud.select(F.col("name").alias("wrong"), "n")
    have = cloud.select(F.col("name").alias("right"), F.col("n").alias("merges"))
    return table.join(n, "wrong").join(have, "right", "left").where("wrong <> right").select("wrong", "right", "n", F.coalesce("merges", F.lit(0)).alias("merges"))


def tempo_keys(df: DataFrame, bpm: str, reach: int) -> DataFrame:
    """df with one row for each tempo bucket within `reach` of its tempo (0: its own)."""
    at = F.floor(F.ln(bpm) / BUCKET)
    return df.withColumn("bucket", F.explode(F.sequence(at - reach, at + reach))) if reach else df.withColumn("bucket", at)


def near_tempo(asked: DataFrame, pool: DataFrame, tolerance: float, on: list[str] | None = None) -> DataFrame:
    """(id, other, d, *on): pairs of asked (id, bpm) and pool (other, other_bpm) within a tempo tolerance, half and double time included.

    An equi-join on logarithmic tempo buckets and the columns `on`: the asked side is copied to the buckets
    its tolerance reaches, the pool to those of its tempo, half and double of it. A pair is kept at the
    form that gives its distance, so none comes twice and nothing has to be grouped.
    """
    on = on or []
    reach = int(tolerance * 1.1 / BUCKET) + 1
    left = tempo_keys(asked.where("bpm > 0").select("id", "bpm", *on), "bpm", reach)
    forms = pool.where("other_bpm > 0").select("other", "other_bpm", *on, F.explode(F.array(F.col("other_bpm"), F.col("other_bpm") * 2, F.col("other_bpm") * 0.5)).alias("form"))
    met = left.join(tempo_keys(forms, "form", 0), ["bucket", *on]).where("id <> other")
    d = bpm_distance(F.col("bpm"), F.col("other_bpm"))
    return met.withColumn("d", d).where((F.col("d") <= tolerance) & (F.abs(F.col("bpm") - F.col("form")) / F.col("bpm") == F.col("d"))).select("id", "other", "d", *on)


def first_of_each(pool: DataFrame, by: list[str], most: int) -> DataFrame:
    """The `most` smallest `other` of every combination of `by`.

    Rows that agree in `by` are equally near to anything asked, and ties go by id, so none beyond the first
    `most` can be among the nearest `most`. Spark cuts each partition before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy("other")
    return pool.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= most).drop("r_")


def key_neighbours(asked: DataFrame, view: DataFrame, tolerance: float = 0.06, limit: int = 60) -> DataFrame:
    """(id, pos, other, d): for each asked track the nearest in tempo whose key can follow; ties by id. Tracks without tempo are no neighbours."""
    moves = F.broadcast(key_moves(view.sparkSession).where("level = 1").select(F.col("src").alias("key"), F.col("dst").alias("to")))
    ways = asked.select("id", "bpm", "key").join(moves, "key").select("id", "bpm", "to")
    pool = view.where("bpm > 0 and key <> ''").select(F.col("id").alias("other"), F.col("bpm").alias("other_bpm"), F.col("key").alias("to"))
    w = Window.partitionBy("id").orderBy(F.round("d", 9), "other")
    near = near_tempo(ways, first_of_each(pool, ["to", "other_bpm"], limit + 1), tolerance, ["to"])
    return near.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select("id", "pos", "other", F.round("d", 9).alias("d"))


def similar_tracks(asked: DataFrame, pool: DataFrame, tolerance: float = 0.08, limit: int = 60) -> DataFrame:
    """(id, other): the first `limit` tracks that share a genre or family with an asked one and lie within a tempo tolerance.

    The same genre comes first, then the nearer tempo, then the id. A track without tempo is near to all, but
    after those that are measured, and all are equally near to an asked one without.
    """
    kinds = lambda df: df.select("id", F.explode("genres").alias("g")).where("g is not null and g <> ''").select("id", F.explode(F.array(F.concat(F.lit("g:"), "g"), F.concat(F.lit("f:"), genre_family(F.col("g"))))).alias("kind")).where(F.col("kind") != f"f:{NO_FAMILY}").distinct()
    tempo = F.when(F.col("bpm") > 0, F.col("bpm")).alias("tempo")
    left = materialise(kinds(asked).join(asked.select("id", tempo), "id"))
    right = kinds(pool).join(pool.select("id", tempo), "id").select(F.col("id").alias("other"), F.col("tempo").alias("other_bpm"), "kind")
    classes = materialise(first_of_each(right, ["kind", "other_bpm"], limit + 1))
    near = near_tempo(left.withColumnRenamed("tempo", "bpm"), classes, tolerance, ["kind"]).select("id", "other", "d", "kind")
    # of one kind only the nearest can be among the first; they are cut before anything is grouped
    nearest = Window.partitionBy("id", "kind").orderBy(F.round("d", 9), "other")
    near = near.withColumn("r_", F.row_number().over(nearest)).where(F.col("r_") <= limit).drop("r_")
    unmeasured = left.where("tempo is not null").join(classes.where("other_bpm is null"), "kind").select("id", "other", F.lit(1.0).alias("d"), "kind")
    everyone = left.where("tempo is null").join(first_of_each(classes, ["kind"], limit + 1), "kind").select("id", "other", F.lit(1.0).alias("d"), "kind")
    met = near.unionByName(unmeasured).unionByName(everyone).where("id <> other").groupBy("id", "other").agg(F.min("d").alias("d"), F.min(F.when(F.col("kind").startswith("g:"), 0).otherwise(1)).alias("rank"))
    w = Window.partitionBy("id").orderBy("rank", F.round("d", 9), "other")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select("id", "other")


def suggest_tags(asked: DataFrame, view: DataFrame, vocabulary: DataFrame, floor: float = 0.45, limit: int = 60, least: int = 6, top: int = 8) -> DataFrame:
    """(id, name, n, share): tags that many of a track's similar tracks carry and it does not.

    vocabulary: (name), the tags that may be suggested. Only similar tracks that carry a tag of it are
    decided; both the similar and the decided ones must be `least`. share is n over the decided ones, and
    only tags of at least `floor` count. The first `top` by share, then name.
    """
    pool = view.where(F.exists("tags", lambda t: t.isNotNull()))
    similar = similar_tracks(asked, pool, limit=limit)
    names = vocabulary.select("name").where("name is not null").distinct()
    tags = pool.select(F.col("id").alias("other"), F.explode(F.array_distinct("tags")).alias("name")).join(names, "name")
    carried = similar.join(tags, "other")
    sizes = similar.groupBy("id").agg(F.count("*").alias("pool")).join(carried.groupBy("id").agg(F.countDistinct("other").alias("decided")), "id").where((F.col("pool") >= least) & (F.col("decided") >= least))
    have = asked.select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("have"))
    counted = carried.groupBy("id", "name").agg(F.count("*").alias("n")).join(sizes, "id").join(have, "id").where(~F.coalesce(F.array_contains("have", F.col("name")), F.lit(False)) & (F.col("n") / F.col("decided") >= floor))
    best = Window.partitionBy("id").orderBy(F.desc(F.round(F.col("n") / F.col("decided"), 2)), "name")
    return counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("id", "name", "n", F.round(F.col("n") / F.col("decided"), 2).alias("share"))


def guess_banks(tag: DataFrame, kinds: tuple[str, ...], least: int = 2) -> DataFrame:
    """(mood, timing, kind): which group of tags is the mood, which the stages of a night, which the kind of night, by content.

    timing: the group with most tags that name a stage, if `least` do; mood: the largest other group; kind: of
    the rest the one with most words of `kinds` in its names, if `least` are there, else the largest. Of
    equals the first by (seq, name); '' for none. The vocabulary is one row a group once it is counted.
    """
    groups = tag.where("attribute = 1").select(F.col("id").alias("parent_id"), F.col("name").alias("bank"), "seq")
    each = tag.where("attribute = 0").select("parent_id", F.lower("name").alias("low"), arc_stage(F.col("name")).isNotNull().cast("int").alias("staged"))
    words_ = [F.max(F.contains(F.col("low"), F.lit(w)).cast("int")) for w in kinds]
    counts = each.groupBy("parent_id").agg(F.count("*").alias("size"), F.sum("staged").alias("stages"), sum(words_[1:], words_[0]).alias("words"))
    rows = groups.join(counts, "parent_id", "left").select("bank", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("stages", F.lit(0)).alias("stages"), F.coalesce("words", F.lit(0)).alias("words"), "seq")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("seq", "bank", "size", "stages", "words"))).alias("b"))

    def best(by: str, taken: list[Column], floor: int) -> Column:
        free = F.filter("b", lambda x: (x[by] >= floor) & reduce(lambda ok, t: ok & (x["bank"] != t), taken, F.lit(True)))
        most = F.array_max(F.transform(free, lambda x: x[by]))
        return F.coalesce(F.get(F.filter(free, lambda x: x[by] == most), 0)["bank"], F.lit(""))

    timed = listed.withColumn("timing", best("stages", [], least))
    mooded = timed.withColumn("mood", best("size", [F.col("timing")], 0))
    taken = [F.col("timing"), F.col("mood")]
    worded = best("words", taken, least)
    return mooded.select("mood", "timing", F.when(worded != "", worded).otherwise(best("size", taken, 0)).alias("kind"))


def ordered_tags(tag: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bank, pos, name): the tags of each group in the order of `wanted` (bank, name, place), those without a place after them as they were."""
    groups = tag.where("attribute = 1").select(F.col("id").alias("parent_id"), F.col("name").alias("bank"))
    rows = tag.where("attribute = 0").select("name", "parent_id", "seq").join(groups, "parent_id").join(wanted, ["bank", "name"], "left")
    w = Window.partitionBy("bank").orderBy(F.col("place").asc_nulls_last(), "seq", "name")
    return rows.select("bank", F.row_number().over(w).alias("pos"), "name")


def vocabulary_plan(tag: DataFrame, starter: DataFrame) -> DataFrame:
    """(bank, name, bank_exists, exists): which groups and tags of a starter vocabulary (bank, name) are there already, in any case."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    groups = tag.where("attribute = 1").select("id", plain(F.col("name")).alias("b")).groupBy("b").agg(F.max("id").alias("id"))
    have = tag.where("attribute <> 1").select(F.col("parent_id").alias("id"), plain(F.col("name")).alias("n")).distinct().withColumn("there", F.lit(True))
    rows = starter.select("bank", "name", F.lower("bank").alias("b"), F.lower("name").alias("n")).join(groups, "b", "left").join(have, ["id", "n"], "left")
    return rows.select("bank", "name", F.col("id").isNotNull().alias("bank_exists"), F.coalesce("there", F.lit(False)).alias("exists"))
