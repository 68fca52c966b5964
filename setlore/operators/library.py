"""Scans and views of a library: tracks with their tags, playlists, sessions, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlore.functions.music import normalize_key, tempo
from setlore.functions.text import comment_energy, fold, split_genres
from setlore.operators.measures import global_rank
from setlore.session import materialise


def live_tags(song_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """(content_id, tag_id, name, cat, catseq): live tags of each track with their group; sequence 99 where the group is unknown.

    Repeated bridge rows count once; deleted rows and tags without an entry are left out.
    """
    groups = tag.select(F.col("id").alias("parent_id"), F.col("name").alias("cat"), F.col("seq").alias("catseq"))
    named = tag.where("attribute = 0").select(F.col("id").alias("tag_id"), "name", "parent_id").join(groups, "parent_id", "left")
    live = song_tag.where("deleted = 0").select("content_id", "tag_id").distinct()
    return live.join(named, "tag_id").select("content_id", "tag_id", "name", "cat", F.coalesce("catseq", F.lit(99)).alias("catseq"))


def track_scan(track: DataFrame, song_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """Local tracks with coerced numbers and their tags in order of (group, name)."""
    tags = live_tags(song_tag, tag).groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("catseq", "name"))).alias("tags"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return track.where(F.col("path").rlike(r"^(/|[A-Za-z]:)")).join(tags, F.col("id") == F.col("content_id"), "left").select(
        "id", F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).otherwise(F.trim("title")).alias("title"),
        zero("rb_length").alias("seconds"), zero("rb_bitrate").alias("kbps"), zero("rating").alias("rating"), tempo(F.col("bpm")).alias("bpm"), F.array_join("tags.name", "|").alias("tags"),
    )


def playlist_entries(track: DataFrame) -> DataFrame:
    return track.select(F.col("id").alias("track"), F.explode("playlists").alias("p")).select(F.col("p.id").alias("playlist"), F.col("p.name").alias("name"), F.col("p.trackno").alias("trackno"), "track")


def renumber(entries: DataFrame) -> DataFrame:
    """(playlist, pos, track): the first place of every track in every playlist, numbered 1..n again."""
    first = entries.groupBy("playlist", "track").agg(F.min(F.coalesce("trackno", F.lit(0))).alias("at"))
    return first.select("playlist", F.row_number().over(Window.partitionBy("playlist").orderBy("at", "track")).alias("pos"), "track")


def sessions(song_history: DataFrame, history: DataFrame) -> DataFrame:
    """(session, day, trackno, content): live plays of live sessions; day '' where it is unknown."""
    live = history.where("deleted = 0").select(F.col("id").alias("session"), F.coalesce(F.substring("date_created", 1, 10), F.lit("")).alias("day"))
    plays = song_history.where("deleted = 0").select(F.col("history_id").alias("session"), F.coalesce("track_no", F.lit(0)).alias("trackno"), F.col("content_id").alias("content")).where("content is not null")
    return plays.join(live, "session")


def transitions(played: DataFrame) -> DataFrame:
    """(src, dst, n): how often dst came right after src in a session; equal neighbours are skipped and not bridged."""
    w = Window.partitionBy("session").orderBy("trackno", "content")
    pairs = played.select(F.col("content").alias("src"), F.lead("content").over(w).alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def last_played(played: DataFrame) -> DataFrame:
    return played.where("day <> ''").groupBy("content").agg(F.max("day").alias("last"))


def view(track: DataFrame) -> DataFrame:
    """What a set builder reads of a track: normalised key, split genres, energy and note, search text."""
    energy, note = comment_energy(F.col("comment"))
    text = [F.coalesce(c, F.lit("")) for c in ("artist", "title", "genre", "comment", "key")]
    return track.select(
        "id", tempo(F.col("bpm")).alias("bpm"), normalize_key(F.col("key")).alias("key"), split_genres(F.col("genre")).alias("genres"), energy.alias("energy"), note.alias("note"),
        F.coalesce("rb_bitrate", F.lit(0)).alias("kbps"), fold(F.concat_ws(" ", *text)).alias("search"),
    )


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, depth): names from the root joined by ' / ', for trees of any depth.

    nodes: id, name, parent_id, one row an id. Paths double in length each round, by a join with the table
    itself, so a tree of depth d takes log d rounds. A node without parent, or whose parent is not in the table, is a root.
    Nodes on a cycle and below one have no root and no row; a round in which no node reaches its root tells them.
    """
    known = nodes.select(F.col("id").alias("parent_id")).distinct().withColumn("there", F.lit(True))
    start = nodes.select("id", "name", "parent_id").join(known, "parent_id", "left").select("id", F.col("name").alias("path"), F.when(F.col("there"), F.col("parent_id")).alias("up"), F.lit(0).alias("depth"))
    rows, before = materialise(start), None
    while True:
        open_ = rows.where("up is not null").count()
        if not open_ or open_ == before:
            return rows.where("up is null").select("id", "path", "depth")
        above = rows.select(F.col("id").alias("up"), F.col("path").alias("path2"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        joined = rows.join(above, "up", "left")
        rows, before = materialise(joined.select("id", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat_ws(" / ", "path2", "path")).alias("path"), F.col("up2").alias("up"), F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("depth2") + 1).alias("depth"))), open_


def next_in_order(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with `next`: the id of the row that follows in its group, the first one after the last.

    order: a total order within the group. The table is range-partitioned by (group, order), so a group that
    holds most rows is spread; the follower is found by its place.
    """
    ranked = materialise(global_rank(df, [F.col(group).asc(), *order], "i"))
    after = ranked.select((F.col("i") - 1).alias("i"), F.col(group), F.col("id").alias("after"))
    first = ranked.groupBy(group).agg(F.min(F.struct("i", "id")).alias("first")).select(group, "first.id")
    return ranked.join(after, ["i", group], "left").join(first.withColumnRenamed("id", "first"), group).withColumn("next", F.coalesce("after", "first")).drop("i", "after", "first")


def tally(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
