"""Beat grids, phrases and transitions between two tracks; comments merged in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.functions.text import comment_energy

# Phrase kinds of intros, and of outros by mood; limits of tempo drift and of bars.
INTRO = 1
OUTRO = {1: (6,), 2: (10,), 3: (10,)}
COMFORTABLE, FARTHEST = 0.03, 0.08
BARS = (8, 64)


def phrase_seconds(phrases: DataFrame, grids: DataFrame) -> DataFrame:
    """(id, kind, beat, at): the second at which a phrase begins, its beat clamped to the grid; without a grid none."""
    joined = phrases.join(grids.where(F.size("beats") > 0), "id")
    place = F.greatest(F.lit(1), F.least(F.size("beats"), F.coalesce("beat", F.lit(0))))
    return joined.select("id", "kind", "beat", F.element_at("beats", place).alias("at"))


def body_start(phrases: DataFrame, grids: DataFrame) -> DataFrame:
    """(id, at): where the first phrase begins that is neither intro nor outro of its mood; null beyond the grid."""
    outro = F.lit(False)
    for mood, kinds in OUTRO.items():
        outro = outro | ((F.col("mood") == mood) & F.col("kind").isin(*kinds))
    outro = outro | (~F.coalesce("mood", F.lit(0)).isin(*OUTRO) & F.col("kind").isin(6, 10))
    first = phrases.where((F.col("kind") != INTRO) & ~outro).groupBy("id").agg(F.min(F.struct("pos", "beat")).alias("p"))
    beat = F.col("p.beat")
    return first.join(grids, "id").select("id", F.when((beat > 0) & (beat <= F.size("beats")), F.round(F.element_at("beats", beat), 2)).alias("at"))


def slice_means(frames: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, i, mean): frames (id, t, x) averaged between consecutive edges (id, at); a slice without frames takes the next one."""
    w = Window.partitionBy("id").orderBy("at")
    spans = edges.select("id", "at", F.lead("at").over(w).alias("to"), (F.row_number().over(w) - 1).alias("i")).where("to is not null")
    rows = frames.select("id", "t", "x")
    inside = spans.join(rows, (spans["id"] == rows["id"]) & (rows["t"] >= spans["at"]) & (rows["t"] < spans["to"]), "left").select(spans["id"], "i", "at", "x")
    means = inside.groupBy("id", "i", "at").agg(F.avg("x").alias("mean"))
    bare = means.where("mean is null").select("id", "i", "at")
    after = bare.join(rows, "id").where("t >= at").groupBy("id", "i").agg(F.min(F.struct("t", "x")).alias("n")).select("id", "i", F.col("n.x").alias("next"))
    return means.join(after, ["id", "i"], "left").select("id", "i", F.coalesce("mean", "next", F.lit(0.0)).alias("mean"))


def tempo_marks(beats: Column, slack: float = 0.003) -> Column:
    """Beats (at, bpm, beat) at which the tempo changes or the beat leaves the line of the last mark by more than `slack` seconds."""
    kind = "array<struct<at:double,bpm:double,beat:int>>"
    start = F.struct(F.array().cast(kind).alias("marks"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("bpm"), F.lit(0).alias("since"))

    def step(state: Column, b: Column) -> Column:
        same = F.coalesce((b["bpm"] == state["bpm"]) & (b["bpm"] > 0), F.lit(False))
        on_line = same & (F.abs(state["at"] + (state["since"] + 1) * 60.0 / b["bpm"] - b["at"]) <= slack)
        mark = F.struct(b["at"].cast("double").alias("at"), b["bpm"].cast("double").alias("bpm"), b["beat"].cast("int").alias("beat"))
        kept = F.struct(state["marks"].alias("marks"), state["at"].alias("at"), state["bpm"].alias("bpm"), (state["since"] + 1).alias("since"))
        new = F.struct(F.concat(state["marks"], F.array(mark)).alias("marks"), b["at"].cast("double").alias("at"), b["bpm"].cast("double").alias("bpm"), F.lit(0).alias("since"))
        return F.when(F.coalesce(on_line, F.lit(False)), kept).otherwise(new)

    return F.aggregate(beats, start, step)["marks"]


def mix_plan(pairs: DataFrame, bars: int = 32) -> DataFrame:
    """How to go from a to b: out, in, blend, tempo and whether it is usable.

    pairs: bpm_a, grid_a, marks_a (phrase seconds), bpm_b, grid_b, phrases_b (kind, at). The blend begins at
    the last phrase that leaves room for it, else a whole number of beats before the end.
    """
    bars = max(BARS[0], min(BARS[1], bars))
    a = F.coalesce(F.nullif("bpm_a", F.lit(0.0)), F.lit(125.0))
    b = F.coalesce(F.nullif("bpm_b", F.lit(0.0)), a)
    span = F.lit(bars * 4 * 60.0) / a
    has_a, has_b = F.size("grid_a") > 0, F.size("grid_b") > 0
    latest = F.element_at("grid_a", -1) - span
    fits = F.filter("marks_a", lambda t: t <= latest)
    back = F.greatest(F.lit(1), F.size("grid_a") - F.floor(span / (F.lit(60.0) / a)).cast("int"))
    out = F.when(~has_a, None).when(latest <= 0, 0.0).when(F.size(fits) > 0, F.element_at(fits, -1)).otherwise(F.element_at("grid_a", back))
    body = F.filter("phrases_b", lambda p: p["kind"] != INTRO)
    first = F.when(has_b, F.element_at("grid_b", 1)).otherwise(0.0)
    intro = F.when(has_b & (F.size(body) > 0), F.element_at(body, 1)["at"] - first).otherwise(0.0)
    drift = F.abs(a / b - 1)
    return pairs.select(
        "*", F.round(out, 2).alias("out_at"), F.round(first, 2).alias("in_at"), F.lit(bars).alias("bars"), F.round(span, 2).alias("blend"), F.round(a / b, 5).alias("ratio"), F.round(intro, 1).alias("intro"),
        F.when(drift > FARTHEST, "too far").when(drift > COMFORTABLE, "audible").otherwise("").alias("tempo_note"), (intro > span).alias("intro_outlasts"), (has_a & has_b & (drift <= FARTHEST)).alias("usable"),
    )


def merge_comments(comments: Column) -> Column:
    """An ordered array of comments as one: the first energy, then each different description, ' · ' between; another energy is noted."""
    def parts(c: Column) -> Column:
        energy, note = comment_energy(c)
        return F.struct(energy.alias("energy"), note.alias("note"))

    start = F.struct(F.lit(None).cast("int").alias("energy"), F.array().cast("array<string>").alias("notes"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        clash = F.coalesce(s["energy"] != p["energy"], F.lit(False))
        said = F.format_string("energy %d on the other copy", p["energy"])
        note = F.when(clash, F.when(p["note"] == "", said).otherwise(F.concat(p["note"], F.lit(" ("), said, F.lit(")")))).otherwise(p["note"])
        key = F.lower(F.regexp_replace(note, r"\s+", " "))
        new = (note != "") & ~F.array_contains(s["seen"], key)
        return F.struct(F.coalesce(s["energy"], p["energy"]).alias("energy"), F.when(new, F.concat(s["notes"], F.array(note))).otherwise(s["notes"]).alias("notes"), F.when(new, F.concat(s["seen"], F.array(key))).otherwise(s["seen"]).alias("seen"), (s["n"] + 1).alias("n"))

    merged = F.aggregate(F.transform(comments, parts), start, step)
    text = F.array_join(merged["notes"], " · ")
    energy = merged["energy"]
    return F.when(energy.isNull() & (text == ""), None).when(energy.isNull(), text).when(text == "", energy.cast("string")).otherwise(F.concat(energy.cast("string"), F.lit(" - "), text))
