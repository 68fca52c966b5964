"""References that stand inside text or binary data: paths and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extensions at which a stored path ends.
AUDIO = ("aiff", "aif", "flac", "mp3", "wav", "m4a", "alac", "aac")
FOLDER_PATTERN = r"/[A-Za-z]+/[0-9]{4}-[0-9]{2}/"
DATE_PATTERN = r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b"


def referenced_paths(df: DataFrame, id_col: str, text: str, pattern: str = FOLDER_PATTERN) -> DataFrame:
    """(id_col, path): the distinct matches of a path pattern in each text. Null texts give none."""
    return df.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("path")).distinct()


def device_paths(df: DataFrame, id_col: str, content: str, root: str = "/Contents/") -> DataFrame:
    """(id_col, path): audio paths under a root inside binary content read as UTF-8 without malformed bytes, each cut at the first audio extension within 512 characters."""
    text = F.replace(F.make_valid_utf8(F.col(content).cast("string")), F.lit("\ufffd"), F.lit(""))
    pattern = rf"(?i){root}[^\x00-\x1f]{{0,{512 - len(root)}}}?\.(?:{'|'.join(AUDIO)})"
    return df.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("path"))


def dates_in(df: DataFrame, text: str) -> DataFrame:
    """(n, days, first, last): the ISO dates in a column of texts, counted, distinct, least and greatest."""
    each = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(DATE_PATTERN), F.lit(0))).alias("x"))
    return each.agg(F.count("*").alias("n"), F.countDistinct("x").alias("days"), F.min("x").alias("first"), F.max("x").alias("last"))


# Suffixes of folders that are one thing to their user, and the extensions of music that is taken in.
BUNDLES = (".app", ".logicx", ".band", ".photoslibrary", ".musiclibrary")
MUSIC = (".flac", ".wav", ".aif", ".aiff", ".mp3", ".m4a", ".aac", ".ogg", ".opus", ".alac", ".wma")


def listed(files: DataFrame, root: str, done: str = "processed") -> DataFrame:
    """(path, ext, kind) of files below a root: no hidden file or folder, nothing inside bundles or the folder `done` right under the root, music only.

    kind: 'convert' for .flac, 'copy' for the rest. files: path.
    """
    below = F.substring("path", len(root) + 2, 1 << 30)
    parts = F.split(below, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bundle = F.exists(folders, lambda p: F.lower(p).rlike("(?:" + "|".join(b.replace(".", r"\.") for b in BUNDLES) + ")$"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = files.where(F.startswith("path", F.lit(f"{root}/"))).where(~F.exists(parts, lambda p: F.startswith(p, F.lit("."))) & ~bundle & ~F.coalesce(F.get(folders, F.lit(0)) == done, F.lit(False)))
    return rows.where(ext.isin(*MUSIC)).select("path", ext.alias("ext"), F.when(ext == ".flac", "convert").otherwise("copy").alias("kind"))


def links_in(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, url, source): the web links in each text without closing marks, and which reader takes them: 'spotify', 'soundcloud', 'short' or 'none' (F21)."""
    found = df.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"https?://\S+"), F.lit(0)))).alias("url"))
    url = F.regexp_replace("url", r"[).,;\]]+$", "")
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]*)", 1))
    source = F.when(host.rlike(r"spotify\.link|app\.link|on\.soundcloud\.com"), "short").when(host.contains("spotify"), "spotify").when(host.contains("soundcloud"), "soundcloud").otherwise("none")
    return found.select(id_col, url.alias("url")).select(id_col, "url", source.alias("source"))


def fingerprints(files: DataFrame, size: str, changed: str) -> DataFrame:
    """(path, print): what tells whether a file changed, 'size:seconds', '-' where it is missing."""
    known = F.col(size).isNotNull() & F.col(changed).isNotNull()
    return files.select("path", F.when(known, F.concat_ws(":", F.col(size).cast("long"), F.floor(changed).cast("long"))).otherwise("-").alias("print"))
