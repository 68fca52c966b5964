"""Measured quality: duplicate groups and their best copy, players' formats, bands, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setlore.functions.text import norm_text, primary_artist, split_title

#: Copies whose lengths differ by no more seconds are one recording; shorter and longer ones than these are clips and full tracks.
SAME_LENGTH, SHORT_CLIP, FULL_TRACK = 3.0, 30.0, 60.0
# Players, the formats they read, whether they read ALAC, bits, rate, and bits in doubt.
DEVICES = (
    ("nxs2", (".mp3", ".m4a", ".mp4", ".wav", ".aiff", ".aif", ".flac"), True, 24, 48000, None),
    ("nxs", (".mp3", ".m4a", ".mp4", ".wav", ".aiff", ".aif"), False, 24, 48000, None),
    ("entry", (".mp3", ".m4a", ".mp4", ".wav", ".aiff", ".aif"), False, 24, 48000, 16),
)
BANDS = ((128, "le128"), (256, "le256"), (320, "le320"))


def probes(probe: DataFrame) -> DataFrame:
    """One row a path; the bitrate is derived from size and duration where it is missing."""
    rate = F.coalesce(F.col("bitrate"), F.floor(F.try_divide(F.col("size") * 8.0, F.col("duration"))).cast("int"))
    cut = probe.where("path is not null").select("path", "exists", "size", "duration", rate.alias("bitrate"), "rate", "depth", F.coalesce("lossless", F.lit(False)).alias("lossless"), "codec")
    return cut.groupBy("path").agg(F.max(F.struct(*cut.columns[1:])).alias("m")).select("path", "m.*")


def measured(track: DataFrame, probe: DataFrame) -> DataFrame:
    return track.join(probes(probe), "path", "left")


def audio_rank(lossless: Column, depth: Column, rate: Column, bitrate: Column) -> Column:
    """(lossless, bits times rate or bitrate): comparable as a struct. Unknown depth is 16, unknown rate 44100."""
    full = F.coalesce(F.nullif(depth, F.lit(0)), F.lit(16)).cast("long") * F.coalesce(F.nullif(rate, F.lit(0)), F.lit(44100))
    yes = F.coalesce(lossless, F.lit(False))
    return F.struct(yes.cast("int").alias("lossless"), F.when(yes, full).otherwise(F.coalesce(bitrate, F.lit(0)).cast("long")).alias("amount"))


def work_score(tags: Column, cues: Column, lists: Column, comment: Column, rating: Column) -> Column:
    """How much work a copy carries: tags and cues count two, playlists three, a comment two, a rating one."""
    zero = F.lit(0)
    return F.greatest(F.size(tags), zero) * 2 + F.coalesce(cues, zero) * 2 + F.greatest(F.size(lists), zero) * 3 + F.when(F.coalesce(comment, F.lit("")) != "", 2).otherwise(0) + F.when(F.coalesce(rating, zero) != 0, 1).otherwise(0)


def readable(ext: Column, codec: Column) -> Column:
    """Does even the oldest player read it?"""
    return F.lower(ext).isin(*DEVICES[-1][1]) & ~(F.lower(ext).isin(".m4a", ".mp4") & F.coalesce(codec == "ALAC", F.lit(False)))


def with_key(track: DataFrame) -> DataFrame:
    """track with its duplicate key (artist, base, version); the base is '' where the title has none."""
    base, version = split_title(F.col("title"))
    return track.withColumns({"k_artist": primary_artist(F.col("artist")), "k_base": base, "k_version": version})


def keyed(track: DataFrame) -> DataFrame:
    """track with its duplicate key; rows without a base title are left out."""
    return with_key(track).where("k_base <> ''")


KEY = ("k_artist", "k_base", "k_version")


def duplicate_groups(track: DataFrame, probe: DataFrame) -> DataFrame:
    """One row a group of two or more copies: key, n, spread, tied, verdict, best.

    Everything is an aggregate by key, so a group of any size is combined map-side. best: the copy of the
    highest quality; at equal quality the one with most work; then one that every player reads, if the
    best is not and has no cues. Of equals the greatest id.
    """
    rows = keyed(measured(track, probe))
    seconds = F.coalesce(F.nullif("duration", F.lit(0.0)), F.nullif(F.col("rb_length").cast("double"), F.lit(0.0)))
    rank = audio_rank(F.col("lossless"), F.col("depth"), F.col("rate"), F.col("bitrate"))
    size = F.coalesce("size", F.lit(0))
    plays = readable(F.col("ext"), F.col("codec"))
    work = work_score(F.col("mytags"), F.col("cues"), F.col("playlists"), F.col("comment"), F.col("rating"))
    copy = F.struct("rank", "fsize", "id", "plays", F.coalesce("cues", F.lit(0)).alias("cues"))
    rows = rows.select(*KEY, "id", "cues", seconds.alias("seconds"), rank.alias("rank"), size.alias("fsize"), plays.alias("plays"), work.alias("work"))
    g = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.max("seconds").alias("long"), F.min("seconds").alias("short"), F.count("seconds").alias("timed"),
        (F.min("rank") == F.max("rank")).alias("tied"), (F.min("fsize") == F.max("fsize")).alias("same_size"),
        F.max(copy).alias("top"), F.max(F.struct("work", copy.alias("copy"))).alias("curated"), F.max(F.when(F.col("plays"), copy)).alias("everywhere"),
    ).where("n > 1")
    spread = F.when(F.col("timed") > 1, F.col("long") - F.col("short")).otherwise(0.0)
    best = F.when(F.col("tied") & (F.col("curated.work") > 0), F.col("curated.copy")).otherwise(F.col("top"))
    g = g.withColumn("best", best)
    chosen = F.when(F.col("tied") & ~F.col("best.plays") & (F.col("best.cues") == 0) & F.col("everywhere").isNotNull(), F.col("everywhere.id")).otherwise(F.col("best.id"))
    verdict = F.when((F.col("short") < SHORT_CLIP) & (F.col("long") > FULL_TRACK), "mistagged").when((spread <= SAME_LENGTH) & F.col("same_size"), "identical").when(spread <= SAME_LENGTH, "duplicate").otherwise("review")
    return g.select(*KEY, "n", F.round(spread, 1).alias("spread"), "tied", verdict.alias("verdict"), chosen.alias("best"))


def lost_tags(track: DataFrame, groups: DataFrame) -> DataFrame:
    """(best, tag): tags that copies of a group carry and its best copy does not."""
    members = keyed(track).join(groups.select(*KEY, "best"), list(KEY)).select("best", "id", F.explode("mytags.name").alias("tag"))
    have = members.where("id = best").select("best", "tag").distinct()
    return members.where("id <> best").select("best", "tag").distinct().join(have, ["best", "tag"], "left_anti")


def merge_plan(track: DataFrame, groups: DataFrame) -> DataFrame:
    """(best, tags, playlists, rating): what the best copy gains from the others, rating 0 for none higher."""
    rows = keyed(track).join(groups.select(*KEY, "best"), list(KEY)).select("best", "id", F.coalesce("rating", F.lit(0)).alias("rating"), F.transform("mytags", lambda t: t["id"]).alias("tags"), F.transform("playlists", lambda p: p["id"]).alias("lists"))

    def gained(column: str) -> DataFrame:
        each = rows.select("best", "id", F.explode(column).alias("x"))
        return each.groupBy("best", "x").agg(F.max((F.col("id") == F.col("best")).cast("int")).alias("has")).where("has = 0").groupBy("best").agg(F.count("*").alias(column))

    top = rows.groupBy("best").agg(F.max(F.when(F.col("id") == F.col("best"), F.col("rating"))).alias("own"), F.max(F.when(F.col("id") != F.col("best"), F.col("rating"))).alias("other"))
    zero = F.lit(0)
    return top.join(gained("tags"), "best", "left").join(gained("lists"), "best", "left").select("best", F.coalesce("tags", zero).alias("tags"), F.coalesce("lists", zero).alias("playlists"), F.when(F.col("other") > F.col("own"), F.col("other")).otherwise(0).alias("rating"))


def merge_sets(track: DataFrame, groups: DataFrame) -> DataFrame:
    """(best, kind, id, name): the tags and playlists that the best copy of each group would gain from the others, each once."""
    rows = keyed(track).join(groups.select(*KEY, "best"), list(KEY))
    item = lambda kind, column: F.transform(F.coalesce(column, F.array().cast("array<struct<id:string,name:string>>")), lambda x: F.struct(F.lit(kind).alias("kind"), x["id"].alias("id"), x["name"].alias("name")))
    cut = lambda column: F.transform(column, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    each = rows.select("best", (F.col("id") == F.col("best")).alias("own"), F.explode(F.concat(item("tag", cut("mytags")), item("playlist", cut("playlists")))).alias("x"))
    return each.groupBy("best", "x.kind", "x.id").agg(F.max("own").alias("has"), F.min("x.name").alias("name")).where("not has").select("best", "kind", "id", "name")


def ordered_groups(groups: DataFrame, hidden: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """(pos, *KEY, verdict): the first groups by verdict, artist and title; hidden: keys that were marked as no duplicates."""
    order = F.create_map(*[F.lit(x) for pair in (("identical", 0), ("duplicate", 1), ("review", 2), ("mistagged", 3)) for x in pair])[F.col("verdict")]
    shown = groups if hidden is None else groups.join(hidden, list(KEY), "left_anti")
    first = shown.select(*KEY, "verdict", order.alias("o")).orderBy("o", *KEY).limit(limit)
    return first.select(F.row_number().over(Window.orderBy("o", *KEY)).alias("pos"), *KEY, "verdict")


def held_files(files: DataFrame, library: DataFrame) -> DataFrame:
    """(path, how, orig): what the library holds of files that it does not use: 'identical' or 'same', with the library's path.

    files: path, size, digest (of samples of the content, null if unread), artist, title, seconds; library:
    path, size, digest, artist, title, rb_length, id. A file is identical if size and digest agree; the same if its
    length is within three seconds and it has the duplicate key, or else the file name, of a library track.
    Files at a path of the library are used and left out. Of several the smallest library path is given. Every rule is an equi-join on
    keys of distinct library rows reduced to one a (key, length), so a hot key costs no pairs of rows.
    """
    stem = lambda c: norm_text(F.regexp_extract(c, r"([^/]*?)(\.[^./]*)?$", 1))
    loose = files.join(library.select("path"), "path", "left_anti")
    exact = library.where("digest is not null").groupBy("size", "digest").agg(F.min("path").alias("exact"))
    loose = loose.join(exact, ["size", "digest"], "left")
    rest = loose.where("exact is null and seconds is not null")
    timed = library.where("coalesce(rb_length, 0) > 0")
    by_key = keyed(timed).select(F.concat_ws("\x1f", F.lit("k"), *KEY).alias("k"), "rb_length", "path")
    by_stem = timed.select(F.concat(F.lit("s\x1f"), stem(F.col("path"))).alias("k"), "rb_length", "path")
    known = by_key.unionByName(by_stem).groupBy("k", "rb_length").agg(F.min("path").alias("orig"))
    near = F.sequence(F.ceil(F.col("seconds") - SAME_LENGTH).cast("int"), F.floor(F.col("seconds") + SAME_LENGTH).cast("int"))
    k = F.when(F.col("k_base") != "", F.concat_ws("\x1f", F.lit("k"), *KEY))
    asks = with_key(rest).select("path", F.explode(F.array_compact(F.array(k, F.concat(F.lit("s\x1f"), stem(F.col("path")))))).alias("k"), near.alias("near")).select("path", "k", F.explode("near").alias("rb_length"))
    found = asks.join(known, ["k", "rb_length"]).groupBy("path").agg(F.min(F.struct((F.substring("k", 1, 1) == "s").alias("by"), "orig")).alias("m")).select("path", F.lit("same").alias("how"), F.col("m.orig").alias("orig"))
    return loose.where("exact is not null").select("path", F.lit("identical").alias("how"), F.col("exact").alias("orig")).unionByName(found)


def same_recordings(rows: DataFrame) -> DataFrame:
    """(id, class_id, links) of rows (id, rb_length, *KEY): the tracks under one key that a chain of lengths within three seconds joins.

    links: how many others lie within three seconds; rows without any are left out. class_id: the smallest id of the chain.
    Rows are counted by (key, whole length) first, so the windows see each length of a key once.
    """
    counts = rows.groupBy(*KEY, "rb_length").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    w = Window.partitionBy(*KEY).orderBy("rb_length")
    reach = int(SAME_LENGTH)
    marked = counts.withColumn("around", F.sum("n").over(w.rangeBetween(-reach, reach))).withColumn("starts", (F.col("rb_length") - F.coalesce(F.lag("rb_length").over(w), F.col("rb_length") - reach - 1) > reach).cast("int"))
    chained = marked.withColumn("chain", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    classes = chained.withColumn("class_id", F.min("low").over(Window.partitionBy(*KEY, "chain"))).where("around > 1")
    return rows.join(classes.select(*KEY, "rb_length", "class_id", (F.col("around") - 1).alias("links")), [*KEY, "rb_length"]).select("id", "class_id", "links")


def space_check(track: DataFrame, probe: DataFrame, free: float, keep: bool = True) -> DataFrame:
    """(state, n, bytes, need, fits): what a conversion of the lossless files in .flac would do.

    'todo', 'gone' (the file does not exist) or 'taken' (a file with the target's name exists). need: 1.55 of
    the bytes if the originals are kept, else 0.55; fits: does that go into 95 % of the free bytes.
    """
    there = probes(probe).where("exists").select("path", F.col("size").alias("fsize"))
    target = F.lower(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".aiff")))
    names = there.select(F.lower("path").alias("target"), F.lit(True).alias("taken")).distinct()
    rows = track.where(F.lower("ext") == ".flac").select("path", target.alias("target")).join(there, "path", "left").join(names, "target", "left")
    state = F.when(F.col("fsize").isNull(), "gone").when(F.col("taken"), "taken").otherwise("todo")
    sums = rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum("fsize"), F.lit(0)).alias("bytes"))
    need = F.when(F.col("state") == "todo", F.col("bytes") * (1.55 if keep else 0.55)).otherwise(0.0)
    return sums.select("state", "n", "bytes", F.round(need, 2).alias("need"), (need <= free * 0.95).alias("fits"))


def paths_found(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, id, live): the row of the library for each wanted path, case ignored, a live one before a deleted one, then the smallest id."""
    known = rows.select(F.lower("path").alias("low"), "id", "live").groupBy("low").agg(F.min(F.struct((~F.col("live")).alias("dead"), "id")).alias("m"))
    return wanted.select("path", F.lower("path").alias("low")).join(known, "low", "left").select("path", "m.id", (~F.col("m.dead")).alias("live"))


def file_identity(df: DataFrame) -> DataFrame:
    """df with `identity`: device and inode where known, else the path in lower case (J19). Rows of one identity are one file."""
    return df.withColumn("identity", F.when(F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.concat_ws(":", F.lit("fs"), "dev", "ino")).otherwise(F.concat(F.lit("path:"), F.lower("path"))))


def missing_artwork(track: DataFrame, candidates: DataFrame, queued: DataFrame, floor: float = 0.55, limit: int = 4) -> DataFrame:
    """(id, looked, queued, best, n): tracks without artwork, whether candidates were looked for and how good they are.

    track: id, image; candidates: id, url, score, compilation, same_version; queued: id. A url counts once,
    below the floor none; the first `limit` by score, no compilation, same version.
    """
    w = Window.partitionBy("id").orderBy(F.desc("score"), "compilation", F.desc("same_version"), "url")
    once = candidates.groupBy("id", "url").agg(F.max("score").alias("score"), F.min("compilation").alias("compilation"), F.max("same_version").alias("same_version")).where(F.col("score") >= floor)
    kept = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).groupBy("id").agg(F.count("*").alias("n"), F.min(F.when(F.col("r") == 1, F.col("url"))).alias("best"))
    looked = candidates.select("id", F.lit(True).alias("looked")).distinct()
    waiting = queued.select("id", F.lit(True).alias("queued")).distinct()
    rows = track.where(F.coalesce("image", F.lit("")) == "").select("id").join(looked, "id", "left").join(waiting, "id", "left").join(kept, "id", "left")
    return rows.select("id", F.coalesce("looked", F.lit(False)).alias("looked"), F.coalesce("queued", F.lit(False)).alias("queued"), "best", F.coalesce("n", F.lit(0)).alias("n"))


def devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d[0], list(d[1]), *d[2:]) for d in DEVICES], "device string, formats array<string>, alac boolean, max_bits int, max_rate int, doubt_bits int")


def why_not(bits: Column) -> Column:
    """The first reason for which a player does not read a track, null if it does."""
    ext = F.lower("ext")
    return F.when(~F.array_contains("formats", ext), F.concat(F.upper(F.ltrim(ext, F.lit("."))), F.lit(" format"))).when(ext.isin(".m4a", ".mp4") & F.coalesce(F.col("codec") == "ALAC", F.lit(False)) & ~F.col("alac"), "ALAC").when(
        F.coalesce("rb_depth", F.lit(0)) > bits, F.concat(F.col("rb_depth").cast("string"), F.lit("-bit"))
    ).when(F.coalesce("rb_rate", F.lit(0)) > F.col("max_rate"), F.concat(F.round(F.col("rb_rate") / 1000).cast("int").cast("string"), F.lit(" kHz")))


def verdicts(track: DataFrame, probe: DataFrame) -> DataFrame:
    """(id, device, why, why_low): each track of a minute or more beside each player (3 rows, broadcast)."""
    codec = probes(probe).select("path", "codec")
    songs = track.where("coalesce(rb_length, 0) >= 60").select("id", "path", "ext", "rb_depth", "rb_rate").join(codec, "path", "left")
    each = songs.crossJoin(F.broadcast(devices(track.sparkSession)))
    return each.select("id", "device", why_not(F.col("max_bits")).alias("why"), why_not(F.coalesce("doubt_bits", "max_bits")).alias("why_low"))


def bands(track: DataFrame, probe: DataFrame) -> DataFrame:
    """(band, n): lossy files by bitrate; clips under a minute, lossless and unknown ones apart. 'total' counts all but the clips, those over 320 kbps too, which have no band."""
    rows = measured(track, probe)
    seconds = F.coalesce(F.nullif("duration", F.lit(0.0)), F.col("rb_length").cast("double"), F.lit(0.0))
    kbps = F.round(F.coalesce("bitrate", F.lit(0)) / 1000)
    band = F.when(seconds < FULL_TRACK, "clips").when(F.coalesce("lossless", F.lit(False)), "lossless").when(kbps == 0, "unknown")
    for top, name in BANDS:
        band = band.when(kbps <= top, name)
    each = rows.select(F.explode(F.array_compact(F.array(band, F.when(seconds >= FULL_TRACK, "total")))).alias("band"))
    return each.groupBy("band").agg(F.count("*").alias("n"))


def ancestors(path: Column) -> Column:
    """Every folder above a path, the nearest included: '/a/b/c.x' gives '/a', '/a/b'."""
    parts = F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """Files (path, size, status 'used' / 'dupe' / 'unique') added up into every folder above them."""
    each = files.where("path like '/%/%'").select(F.explode(ancestors(F.col("path"))).alias("folder"), F.coalesce("size", F.lit(0)).alias("size"), "status")
    return each.groupBy("folder").agg(F.count("*").alias("audio"), *[F.sum((F.col("status") == x).cast("long")).alias(n) for x, n in (("used", "used"), ("dupe", "dupes"), ("unique", "uniques"))], F.sum("size").alias("bytes"), F.sum(F.when(F.col("status") == "dupe", F.col("size")).otherwise(0)).alias("dupe_bytes"))


def topmost(rollup: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """Folders with nothing used and enough duplicates, without those below another such folder."""
    fits = rollup.where((F.col("used") == 0) & (F.col("dupes") >= least) & (F.col("dupes") >= share * F.col("audio")))
    above = fits.select("folder", F.explode(ancestors(F.concat("folder", F.lit("/x")))).alias("up")).where("up <> folder")
    below = above.join(fits.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return fits.join(below, "folder", "left_anti")
