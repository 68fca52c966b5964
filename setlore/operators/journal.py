"""Change logs and stored copies: compaction, overlay, application, sync, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Operations and the opposite that cancels each.
OPPOSITES = {"add_tag": "remove_tag", "remove_tag": "add_tag", "playlist_add": "playlist_remove", "playlist_remove": "playlist_add"}
SINGLE = ("set_genre", "set_comment", "set_color", "set_rating", "set_title", "set_artist", "set_artwork", "playlist_create")
OPS = (*OPPOSITES, *SINGLE)
# Retention as (age in seconds or none, bucket); the date format of a bucket.
TIERS = ((6 * 3600, None), (2 * 86400, "hour"), (14 * 86400, "day"), (56 * 86400, "week"), (None, "month"))


def _field() -> Column:
    """What an operation touches: a tag by its name, a playlist by its id, else the field itself."""
    return F.when(F.col("op").isin("add_tag", "remove_tag"), F.concat(F.lit("tag:"), F.coalesce("tag", F.lit("")))).when(F.col("op").isin("playlist_add", "playlist_remove"), F.concat(F.lit("list:"), F.coalesce("playlist", F.lit("")))).otherwise(F.regexp_replace("op", "^set_", ""))


def compact(log: DataFrame) -> DataFrame:
    """(track, field, seq, op, value, before): the last operation on each field, with the oldest known `before` for single values.

    log: seq, op, track, tag, playlist, value, before; a null `before` is none. Unknown operations and rows without a track
    are left out. One aggregate by (track, field); nothing is ordered across the log. An operation and its
    opposite share a field, so the later one replaces the earlier; it keeps its own `before`.
    """
    known = log.where(F.col("op").isin(*OPS) & (F.coalesce("track", F.lit("")) != "")).withColumn("field", _field())
    rows = known.groupBy("track", "field").agg(F.max(F.struct("seq", "op", "value", "before")).alias("last"), F.min(F.when(F.col("before").isNotNull(), F.struct("seq", "before"))).alias("first"))
    return rows.select("track", "field", "last.seq", "last.op", "last.value", F.when(F.col("last.op").isin(*SINGLE), F.col("first.before")).otherwise(F.col("last.before")).alias("before"))


def effective(base: DataFrame, compacted: DataFrame) -> DataFrame:
    """base (track, field, value) under the waiting changes: added, replaced or taken out; the change wins."""
    change = compacted.select("track", "field", "op", F.col("value").alias("new"))
    joined = base.join(change, ["track", "field"], "full")
    gone = F.coalesce(F.col("op").isin("remove_tag", "playlist_remove"), F.lit(False))
    value = F.when(F.col("op").isNull(), F.col("value")).when(F.col("op").isin(*SINGLE), F.col("new")).otherwise(F.lit("1"))
    return joined.where(~gone).select("track", "field", value.alias("value"))


def browse_rows(view: DataFrame, compacted: DataFrame) -> DataFrame:
    """One row a track as it will be, beside what the library holds: id, the single values, tags, base.

    view: id, title, artist, genres, rating, comment, color, tags. Tags are added and taken out, each once, sorted.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    names = F.array().cast("array<string>")
    base = {"title": empty("title"), "artist": empty("artist"), "genre": F.array_join(F.coalesce("genres", names), "/"), "rating": F.coalesce("rating", F.lit(0)).cast("string"), "comment": empty("comment"), "color": F.trim(empty("color"))}
    own = view.select("id", F.coalesce("tags", names).alias("tags"), F.struct(*[c.alias(n) for n, c in base.items()]).alias("base"))
    new = [F.max(F.when(F.col("field") == n, F.struct(F.lit(True).alias("set"), "value"))).alias(f"new_{n}") for n in base]
    tag = F.substring_index("field", "tag:", -1)
    some = lambda op: F.collect_set(F.when((F.col("op") == op) & (tag != ""), tag))
    change = compacted.groupBy(F.col("track").alias("id")).agg(*new, some("add_tag").alias("added"), some("remove_tag").alias("removed"))
    rows = own.join(change, "id", "left")
    kept = F.array_sort(F.array_except(F.array_union(F.filter("tags", lambda t: t.isNotNull() & (t != "")), F.coalesce("added", names)), F.coalesce("removed", names)))
    return rows.select("id", *[F.when(F.col(f"new_{n}.set"), F.col(f"new_{n}.value")).otherwise(F.col(f"base.{n}")).alias(n) for n in base], kept.alias("tags"), "base")


def membership(lists: DataFrame, entries: DataFrame, compacted: DataFrame) -> DataFrame:
    """(track, playlist, has): in which playlists each track with a waiting change will stand (J28). lists: (playlist); entries: (playlist, track)."""
    change = compacted.where("field like 'list:%'").select("track", F.substring_index("field", "list:", -1).alias("playlist"), (F.col("op") == "playlist_add").alias("adds"))
    tracks = change.select("track").distinct()
    held = entries.select("playlist", "track").distinct().join(tracks, "track", "left_semi").withColumn("held", F.lit(True))
    both = held.join(change, ["track", "playlist"], "full").join(lists.select("playlist").distinct(), "playlist", "left_semi")
    return both.select("track", "playlist", F.coalesce("adds", "held").alias("has"))


def link_states(links: DataFrame, playlists: DataFrame) -> DataFrame:
    """(link, name, pending, gone): links (link, playlist) beside playlists (playlist, name).

    pending: the playlist is still to be made, its id begins with 'new:'; gone: it is not, though names are known.
    """
    known = playlists.agg((F.count("*") > 0).alias("known"))
    joined = links.join(playlists, "playlist", "left").crossJoin(F.broadcast(known))  # one row
    pending = F.startswith(F.coalesce("playlist", F.lit("")), F.lit("new:"))
    return joined.select("link", F.coalesce("name", F.lit("")).alias("name"), pending.alias("pending"), (~pending & F.col("name").isNull() & F.col("known")).alias("gone"))


def baseline_holds(op: Column, current: Column, before: Column) -> Column:
    """Is the value still what the change was made against? Colours without case and outer blanks, genres by their parts, ratings with 0 for none, artists without outer blanks."""
    plain = lambda c: F.coalesce(c, F.lit(""))
    parts = lambda c: F.array_join(F.filter(F.transform(F.split(plain(c), "/"), lambda x: F.trim(x)), lambda x: x != ""), "/")
    zero = lambda c: F.when(plain(c) == "", "0").otherwise(c)
    same = lambda f: f(current) == f(before)
    return F.when(op == "set_color", same(lambda c: F.lower(F.trim(plain(c))))).when(op == "set_rating", same(zero)).when(op == "set_genre", same(parts)).when(op == "set_artist", same(lambda c: F.trim(plain(c)))).otherwise(same(plain))


def apply(base: DataFrame, compacted: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track, field, op, outcome): 'applied', 'same' if nothing would change, 'skipped' if the baseline moved, 'missing' without the track."""
    joined = compacted.join(base.withColumnRenamed("value", "current"), ["track", "field"], "left").join(tracks.select("track", F.lit(True).alias("known")), "track", "left")
    paired = ~F.col("op").isin(*SINGLE)
    there = F.col("current").isNotNull()
    wants = F.col("op").isin("add_tag", "playlist_add")
    outcome = F.when(F.col("known").isNull(), "missing").when(paired, F.when(there == wants, "same").otherwise("applied")).when(F.coalesce("current", F.lit("")) == F.coalesce("value", F.lit("")), "same").when(
        F.col("before").isNotNull() & ~baseline_holds(F.col("op"), F.col("current"), F.col("before")), "skipped"
    ).otherwise("applied")
    return joined.select("track", "field", "op", outcome.alias("outcome"))


def sync(have: DataFrame, wanted: DataFrame, added: DataFrame) -> DataFrame:
    """(playlist, track) to add: wanted, not there, and never added before, so what was taken out stays out."""
    return wanted.distinct().join(have, ["playlist", "track"], "left_anti").join(added, ["playlist", "track"], "left_anti")


def keep(stamps: DataFrame, now: Column, tiers: tuple = TIERS) -> DataFrame:
    """(stamp): copies that survive: the newest of its bucket in any window it falls in, and the newest of all.

    stamps: one timestamp column `stamp`. Each tier is one aggregate by bucket; nulls are left out.
    """
    rows = stamps.where("stamp is not null").select("stamp").distinct()
    age = F.unix_seconds(now) - F.unix_seconds(F.col("stamp").cast("timestamp"))
    bucket = {"hour": F.date_format("stamp", "yyyyMMddHH"), "day": F.date_format("stamp", "yyyyMMdd"), "month": F.date_format("stamp", "yyyyMM"), "week": F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("stamp")), F.lit("-"), F.weekofyear("stamp"))}
    out = rows.agg(F.max("stamp").alias("stamp"))
    for window, kind in tiers:
        inside = rows if window is None else rows.where(age <= window)
        out = out.unionByName(inside if kind is None else inside.groupBy(bucket[kind].alias("b")).agg(F.max("stamp").alias("stamp")).select("stamp"))
    return out.where("stamp is not null").distinct()


def within_budget(copies: DataFrame, budget: float, least: int = 2) -> DataFrame:
    """(id, kept): newest first while their sizes fit a budget; the newest `least` always; a budget of 0 or less keeps all.

    copies: id, stamp, bytes; one stored copy a row, a bounded listing.
    """
    w = Window.orderBy(F.desc("stamp"), F.desc("id"))
    total = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return copies.select("id", (F.lit(budget <= 0) | (F.row_number().over(w) <= least) | (total <= budget)).alias("kept"))


def copies_listing(copies: DataFrame) -> DataFrame:
    """(stamp, db, xml, tables, bytes): stored copies (kind, stamp, bytes) of three kinds side by side, one row a stamp."""
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    return copies.where(F.col("stamp").isNotNull() & F.col("kind").isin("db", "xml", "tables")).groupBy("stamp").agg(has("db").alias("db"), has("xml").alias("xml"), has("tables").alias("tables"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def copies_status(listing: DataFrame, now: Column) -> DataFrame:
    """(copies, last, last_text, age, bytes): the newest copy, the newest with text, and how many seconds old the newest is."""
    return listing.agg(F.count("*").alias("copies"), F.max("stamp").alias("last"), F.max(F.when(F.col("xml"), F.col("stamp"))).alias("last_text"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("age", F.unix_seconds(now) - F.unix_seconds(F.col("last").cast("timestamp")))
