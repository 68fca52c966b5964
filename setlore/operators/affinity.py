"""What follows what: transition lift between tags, fit to a set, suggestions spread by quotas."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.functions.music import key_moves
from setlore.functions.text import genre_family
from setlore.session import materialise

#: Evidence at which half of a lift is believed.
CONFIDENCE = 8.0
#: Beats per minute beyond which nothing continues a set.
REACH = 14.0
# The weights of the parts of a fit.
FEEL = {"moods": 0.40, "family": 0.25, "energy": 0.20, "bpm": 0.15}


def tag_pairs(view: DataFrame, banks: tuple[str, ...]) -> DataFrame:
    """(id, tag): 'bank|name' of every tag of the named groups, once each."""
    each = view.select("id", F.explode("banks").alias("bank", "names")).where(F.col("bank").isin(*banks))
    return each.select("id", F.explode("names").alias("name"), "bank").where("name is not null").select("id", F.concat_ws("|", "bank", "name").alias("tag")).distinct()


def damped(n: Column, expected: Column) -> Column:
    return F.ln(n / expected) * (n / (n + CONFIDENCE))


def transition_lift(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag_a, tag_b, n, lift) over edges (src, dst, n) and (id, tag): every tag on the left with every tag on the right.

    The edges are joined with the smaller side's tags first, and pairs are summed map-side before the
    shuffle; the marginals are sums of the pair counts, so the expansion is done once.
    """
    left = tags.select(F.col("id").alias("src"), F.col("tag").alias("tag_a"))
    right = tags.select(F.col("id").alias("dst"), F.col("tag").alias("tag_b"))
    pairs = edges.join(left, "src").join(right, "dst").groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n"))
    a, b = Window.partitionBy("tag_a"), Window.partitionBy("tag_b")
    total = pairs.agg(F.sum("n").alias("total"))
    return pairs.withColumn("na", F.sum("n").over(a)).withColumn("nb", F.sum("n").over(b)).crossJoin(F.broadcast(total)).select(
        "tag_a", "tag_b", "n", damped(F.col("n"), F.col("na").cast("double") * F.col("nb") / F.col("total")).alias("lift")
    )


def type_lift(view: DataFrame, type_bank: str, banks: tuple[str, ...]) -> DataFrame:
    """(kind, tag, n, lift): how much more often than chance a tag stands on tracks of a kind."""
    kinds = tag_pairs(view, (type_bank,)).select("id", F.col("tag").alias("kind"))
    tags = tag_pairs(view, banks)
    joint = kinds.join(tags, "id").groupBy("kind", "tag").agg(F.count("*").alias("n"))
    grand = view.agg(F.count("*").alias("grand"))
    k, t = kinds.groupBy("kind").agg(F.count("*").alias("nk")), tags.groupBy("tag").agg(F.count("*").alias("nt"))
    return joint.join(k, "kind").join(t, "tag").crossJoin(F.broadcast(grand)).select("kind", "tag", "n", damped(F.col("n"), F.col("nk").cast("double") * F.col("nt") / F.col("grand")).alias("lift"))


def compact(lift: DataFrame, floor: float = 0.02) -> DataFrame:
    return lift.where(F.abs("lift") > floor).withColumn("lift", F.round("lift", 4))


def set_weights(view: DataFrame, type_bank: str) -> DataFrame:
    """(kind, weight): share of each kind in the commonest one."""
    counts = tag_pairs(view, (type_bank,)).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.select(F.col("tag").alias("kind"), (F.col("n") / F.max("n").over(Window.partitionBy())).alias("weight"))


def families(view: DataFrame) -> DataFrame:
    return view.select("id", F.explode("genres").alias("g")).where("g is not null and g <> ''").select("id", genre_family(F.col("g")).alias("family")).distinct()


def set_feel(view: DataFrame, mood: str) -> dict[str, DataFrame]:
    """Shares of moods and families over the tracks of a set, and the mean energy and tempo of those that have them."""
    n = view.agg(F.count("*").alias("n"), F.avg("energy").alias("energy"), F.avg(F.nullif("bpm", F.lit(0.0))).alias("bpm"))
    moods = tag_pairs(view, (mood,)).groupBy("tag").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("tag", (F.col("c") / F.col("n")).alias("share"))
    kinds = families(view).groupBy("family").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("family", (F.col("c") / F.col("n")).alias("share"))
    return {"moods": moods, "families": kinds, "means": n}


def feel_fit(view: DataFrame, feel: dict[str, DataFrame], mood: str) -> DataFrame:
    """(id, fit): weighted mean of the parts that both sides have, 0.5 if there are none, 1 for an empty set."""
    total = lambda df: df.agg(F.sum("share").alias("all"))
    got = tag_pairs(view, (mood,)).join(F.broadcast(feel["moods"]), "tag", "left").groupBy("id").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("got")).crossJoin(F.broadcast(total(feel["moods"])))
    moods = got.select("id", F.least(F.lit(1.0), F.col("got") / F.col("all")).alias("moods"))
    got = families(view).join(F.broadcast(feel["families"]), "family", "left").groupBy("id").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("got")).crossJoin(F.broadcast(total(feel["families"])))
    kinds = got.select("id", F.least(F.lit(1.0), F.col("got") / F.col("all")).alias("family"))
    means = feel["means"].select(F.col("n").alias("set_n"), F.col("energy").alias("set_energy"), F.col("bpm").alias("set_bpm"))
    rows = view.select("id", "energy", F.nullif("bpm", F.lit(0.0)).alias("tempo")).join(moods, "id", "left").join(kinds, "id", "left").crossJoin(F.broadcast(means))
    parts = {"moods": F.col("moods"), "family": F.col("family"), "energy": F.greatest(F.lit(0.0), 1 - F.abs(F.col("energy") - F.col("set_energy")) / 3.0), "bpm": F.greatest(F.lit(0.0), 1 - F.abs(F.col("tempo") - F.col("set_bpm")) / F.col("set_bpm") / 0.12)}
    known = {"energy": F.col("energy").isNotNull() & F.col("set_energy").isNotNull(), "bpm": F.col("tempo").isNotNull() & F.col("set_bpm").isNotNull(), "moods": F.col("moods").isNotNull(), "family": F.col("family").isNotNull()}
    weight = sum((F.when(known[p], w).otherwise(0.0) for p, w in FEEL.items()), F.lit(0.0))
    score = sum((F.when(known[p], parts[p] * w).otherwise(0.0) for p, w in FEEL.items()), F.lit(0.0))
    return rows.select("id", F.when(F.col("set_n") == 0, 1.0).when(weight > 0, F.round(F.round(score / weight, 9), 3)).otherwise(0.5).alias("fit"))


def candidates(view: DataFrame, chosen: DataFrame, lift: DataFrame, kinds: DataFrame, type_bank: str, banks: tuple[str, ...], recent: int = 3) -> DataFrame:
    """(id, artist, score, reason): how well each track continues a set.

    chosen: (pos, id), the set in order. lift and kinds: transition_lift and type_lift. Flow is the weighted lift from the tags of the last `recent` tracks, party that of the
    kinds of the set, fresh the share of tags not in the set yet; key moves add, tempo gaps scale.
    """
    spark = view.sparkSession
    ordered = chosen.withColumn("back", F.row_number().over(Window.orderBy(F.desc("pos"))))
    size = chosen.agg(F.least(F.count("*"), F.lit(recent)).alias("k"))
    in_set = view.join(chosen.select("id"), "id", "left_semi")
    tags_of_set = tag_pairs(in_set, banks)
    near = ordered.where(F.col("back") <= recent).crossJoin(F.broadcast(size)).select("id", ((F.col("k") - F.col("back") + 1) / F.col("k")).alias("w"))
    # the flow of a tag adds up over the tracks that carry it; the reason is the best single track and tag
    leads = tags_of_set.join(near, "id").groupBy("tag").agg(F.sum("w").alias("w"), F.max("w").alias("most"), F.min("w").alias("least")).withColumnRenamed("tag", "tag_a")
    flow = lift.join(leads, "tag_a").select("tag_a", F.col("tag_b").alias("tag"), (F.col("lift") * F.col("w")).alias("v"), F.greatest(F.col("lift") * F.col("most"), F.col("lift") * F.col("least")).alias("single"))
    reason = flow.groupBy("tag").agg(F.sum("v").alias("flow"), F.max(F.struct(F.col("single").alias("v"), "tag_a")).alias("top"))
    party = kinds.join(set_weights(in_set, type_bank), "kind").groupBy("tag").agg(F.sum(F.col("lift") * F.col("weight")).alias("party"))
    seen = tags_of_set.select("tag").distinct().withColumn("seen", F.lit(1))
    last = ordered.where("back = 1").select("id").join(view.select("id", F.col("bpm").alias("last_bpm"), F.col("key").alias("last_key")), "id").drop("id")
    pool = view.join(chosen.select("id"), "id", "left_anti")
    tagged = tag_pairs(pool, banks).join(reason, "tag", "left").join(party, "tag", "left").join(seen, "tag", "left")
    scored = tagged.groupBy("id").agg(
        (F.coalesce(F.sum("flow"), F.lit(0.0)) / F.count("*")).alias("flow"), (F.coalesce(F.sum("party"), F.lit(0.0)) / F.count("*")).alias("party"),
        (F.sum(F.when(F.col("seen").isNull(), 1).otherwise(0)) / F.count("*")).alias("fresh"), F.max(F.struct("top.v", "top.tag_a", "tag")).alias("best"),
    )
    rows = scored.join(pool.select("id", F.lower(F.coalesce("artist", F.lit(""))).alias("artist"), "bpm", "key"), "id").crossJoin(F.broadcast(last))
    moves = key_moves(spark).select(F.col("src").alias("last_key"), F.col("dst").alias("key"), "level")
    rows = rows.join(F.broadcast(moves), ["last_key", "key"], "left")
    both = (F.coalesce("bpm", F.lit(0.0)) != 0) & (F.coalesce("last_bpm", F.lit(0.0)) != 0)
    gap = F.least(F.abs(F.col("bpm") - F.col("last_bpm")), F.abs(F.col("bpm") * 2 - F.col("last_bpm")), F.abs(F.col("bpm") / 2 - F.col("last_bpm")))
    near_enough = ~both | (gap <= REACH)
    pace = F.when(both, 1 - gap / REACH * 0.5).otherwise(1.0)
    keyed = F.coalesce(0.45 / F.col("level"), F.lit(0.0))
    score = (F.col("flow") + 0.6 * F.col("party") + 0.5 * F.col("fresh") + keyed) * pace
    return rows.where(near_enough).select("id", "artist", F.round(score, 4).alias("score"), F.when(F.col("best.v").isNotNull(), F.concat_ws(">", "best.tag_a", "best.tag")).alias("reason"))


def diverse(ranked: DataFrame, limit: int = 40, per_artist: int = 2, per_reason: int = 3) -> DataFrame:
    """(pos, id): a walk down the ranking that takes a row while its artist and its reason have room.

    Only taken rows use up room, so this is a walk, not two row numbers. Room never comes back: of the rows of
    one artist and one reason the taken ones are the first, `per_artist` at most, so the others are cut before
    anything is ordered. The rest is walked in pages of 4 * limit rows; artists and reasons without room are
    left out of the next page, so there are at most as many pages as artists and reasons that fill up, and the
    driver holds one page.
    """
    reason = F.coalesce("reason", F.lit(""))
    best = Window.partitionBy("artist", reason).orderBy(F.desc("score"), "id")
    rows = materialise(ranked.select("id", F.coalesce("artist", F.lit("")).alias("artist"), "score", reason.alias("reason")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_artist).drop("r"))
    taken: list[tuple[int, str]] = []
    artists, reasons, last = Counter(), Counter(), None
    while len(taken) < limit:
        full_artists, full_reasons = [a for a, n in artists.items() if n >= per_artist], [r for r, n in reasons.items() if r and n >= per_reason]
        left = rows.where(~F.col("artist").isin(full_artists) & ~F.col("reason").isin(full_reasons))
        if last is not None:
            left = left.where((F.col("score") < last[0]) | ((F.col("score") == last[0]) & (F.col("id") > last[1])))
        page = left.orderBy(F.desc("score"), "id").limit(4 * limit).collect()
        for r in page:
            if len(taken) < limit and artists[r.artist] < per_artist and (not r.reason or reasons[r.reason] < per_reason):
                artists[r.artist] += 1
                reasons[r.reason] += 1
                taken.append((len(taken) + 1, r.id))
        if len(page) < 4 * limit:
            break
        last = (page[-1].score, page[-1].id)
    return ranked.sparkSession.createDataFrame(taken, "pos int, id string")
