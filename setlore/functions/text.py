"""String functions of the library: folding, titles, versions, artists, genres, comments. All in the JVM but `nfkd`."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Words that mark a version of a title; of equal length the first listed wins.
VERSIONS = (
    "original mix", "extended mix", "radio edit", "club mix", "dub mix", "instrumental", "acapella", "a cappella", "remix", "rework", "edit", "bootleg", "mashup", "vip",
    "remaster", "remastered", "live", "extended", "radio", "mix", "version",
)
VERSION_PAIRS, VERSION_WORDS = tuple(w for w in VERSIONS if " " in w), tuple(w for w in VERSIONS if " " not in w)
# Bracketed text that names a version, and bracketed text that names none.
VERSION_HINT = r"(?i)\b(remix|mix|edit|version|versión|dub|bootleg|mashup|rework|refix|vip|instrumental|acapella|acappella|live|extended|radio|club|remaster\w*|intro|outro|transition|short|full|clean|dirty)\b"
NO_VERSION = r"(?i)^(original(\s+(mix|version))?|official(\s+\w+)?|hq|hd|master(ed)?|free\s+download|out\s+now|full\s+track)$"
# Genre families in the order in which their words are tried.
FAMILIES = (
    ("Trance", ("trance", "psyrance", "goa")),
    ("Indie & house", ("indie", "indietronica")),
    ("Techno", ("techno", "minimal")),
    ("House", ("house",)),
    ("Urban", ("hip hop", "hip-hop", "rap", "trap", "r&b", "drill", "jersey")),
    ("Latin & afro", ("reggaeton", "reggeaton", "reggaetek", "dembow", "dancehall", "reggae", "afro", "african", "baile", "flamenco", "gipsy", "balkan", "latin")),
    ("Disco & funk", ("disco", "funk", "groove", "swing", "jazz")),
    ("Bass & breaks", ("bass", "garage", "dubstep", "drum", "hardstyle")),
    ("Pop & other", ("pop", "rock", "punk", "country", "folk", "classical", "ost", "movie", "game", "ballad")),
)
NO_FAMILY = "No family"
# Stages of a night and the words that place a tag there.
STAGES = (("open", "intro", "start", "first"), ("warm",), ("middle", "filler", "main", "build", "groove"), ("peak", "prime", "climax", "banger"), ("clos", "last"), ("outro", "ending"))
# Genre spellings and what they are put right to.
GENRE_FIXES = {"Reggeaton": "Reggaeton", "Pogressive Trance": "Progressive Trance", "Psyrance": "Psytrance", "Hip-Hop": "Hip Hop", "Afro Beat": "Afrobeat", "Psy Techno": "Psytechno", "Drum n Bass": "Drum and Bass", "Nu disco": "Nu Disco", "indietronica": "Indietronica"}
# Patterns of web addresses and shop names in tags.
URL_TEXT = r"(?i)\b(?:https?://|www\.)|\b[a-z0-9-]+\.(?:com|net|org|io|co)\b"
SHOP_TEXT = r"(?i)music\s*master|musicmaster|whoplay|ftpdjemilio|electronicfresh|djsoundtop|beatport\s+top\s+\d+|dj\s*pool|djpool|promo\s*only|bpm\s*supreme|digital\s*dj\s*pool|club\s*killers|crate\s*connect|samplefocus|ytbmp3|downloaded\s+from"
# Tag frames that hold addresses only, whose content decides, and that are never touched.
URL_FRAMES = ("WOAF", "WOAS", "WORS", "WPUB", "WCOM", "WCOP", "WOAR")
MAYBE_FRAMES = ("TENC", "TPUB", "TIT1", "TCOP", "TSSE", "TCOM", "TOWN", "TSRC")
KEPT_FRAMES = ("TBPM", "TKEY", "TIT2", "TPE1", "TPE2", "TCON", "TDRC", "TYER", "TRCK", "TPOS")
# An album title that names a compilation.
COMPILATION = r"(?i)\b(vol(ume)?\.?\s*\d+|various|compilation|best of|hits|the collection|anthems|essentials|selected|presents|sampler|playlist|top \d+|\d{2,4}\s*$|^\d{2,3}\b|mixed by|dj mix)\b"


def _accents() -> tuple[str, str]:
    plain = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000), *range(0x3040, 0x3100)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


def strip_accents(text: Column) -> Column:
    """Letters without their accents (canonical decomposition of Latin, Greek, Cyrillic and kana letters), combining marks dropped."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}", "")


def fold(text: Column) -> Column:
    """Search form: lower case, no accents, punctuation kept. Null gives ''."""
    return strip_accents(F.lower(F.coalesce(text, F.lit(""))))


@arrow_udf(StringType())
def nfkd(text: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks: full-width letters, ligatures and the like become plain ones."""
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return pa.array([x if x is None or x.isascii() else plain(x) for x in text.to_pylist()], pa.string())


def words(text: Column, compat: bool = False) -> Column:
    """Matching form: lower case letters a-z and digits, one blank between words. Null gives ''. compat: by NFKD."""
    folded = F.lower(nfkd(F.coalesce(text, F.lit("")))) if compat else fold(text)
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def norm_text(text: Column) -> Column:
    """Comparable form for duplicates: like words(), with & and + read as 'and'."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[&+]", " and "), r"[^a-z0-9]+", " "))


def base_title(title: Column, compat: bool = False) -> Column:
    """The song without brackets, featured artists and trailing version words; the whole title if nothing is left. compat: by NFKD."""
    bare = words(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[(\[{][^)\]}]*[)\]}]", " "), r"(?is)\b(feat|ft|featuring|with)\.?\s+.*$", " "), compat)
    pairs = F.trim(F.regexp_replace(bare, rf"(?:(?:^|\s)(?:{'|'.join(VERSION_PAIRS)}))+$", ""))
    singles = F.trim(F.regexp_replace(pairs, rf"(?:(?:^|\s)(?:{'|'.join(VERSION_WORDS)}))+$", ""))
    return F.when(singles == "", bare).otherwise(singles)


def version_of(title: Column, compat: bool = False) -> Column:
    """The longest version word inside brackets, '' if there is none; of equal length the first listed. compat: by NFKD."""
    inside = words(F.array_join(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"[(\[{][^)\]}]*[)\]}]"), F.lit(0)), " "), compat)
    listed = sorted(VERSIONS, key=lambda w: -len(w))
    return F.transform(F.array(inside), lambda x: F.coalesce(*[F.when(F.instr(x, w) > 0, w) for w in listed], F.lit("")))[0]  # so that it is made once, not for each word


def split_title(title: Column) -> tuple[Column, Column]:
    """(base, version): brackets that name a version are kept apart, the others and featured artists dropped."""
    raw = F.coalesce(title, F.lit(""))
    inner = F.transform(F.regexp_extract_all(raw, F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1)), lambda x: F.trim(x))
    kept = F.filter(inner, lambda x: x.rlike(VERSION_HINT) & ~x.rlike(NO_VERSION))
    version = F.array_join(F.array_sort(F.filter(F.transform(kept, norm_text), lambda x: x != "")), " ")
    base = norm_text(F.regexp_replace(F.regexp_replace(raw, r"[(\[][^)\]]*[)\]]", " "), r"(?i)\b(feat|ft|featuring)\.?\s+[^()\[\]-]+", " "))
    return base, version


def primary_artist(artist: Column) -> Column:
    """The first artist named, in comparable form."""
    raw = F.regexp_replace(F.coalesce(artist, F.lit("")), r"[&+]", " and ")
    return norm_text(F.get(F.split(raw, r"\s*[,;/]\s*|\s+(?:and|vs|x)\s+", 2), F.lit(0)))


def split_genres(genre: Column) -> Column:
    """The genres of one field, cut at / , ; and |, trimmed, empties left out. Null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(genre, F.lit("")), r"[/,;|]"), lambda g: F.regexp_replace(g, r"^\s+|\s+$", "")), lambda g: g != "")


def comment_energy(comment: Column) -> tuple[Column, Column]:
    """(energy 1..10 or null, note): up to two digits that lead the comment, and what follows a dash, dot or colon."""
    s = F.regexp_replace(F.coalesce(comment, F.lit("")), r"^\s+|\s+$", "")
    pattern = r"(?s)^(\d{1,2})\s*[-–—.:]?\s*(.*)$"
    number = F.regexp_extract(s, pattern, 1).try_cast("int")
    fits = number.between(1, 10)
    return F.when(fits, number), F.when(fits, F.regexp_replace(F.regexp_extract(s, pattern, 2), r"\s+$", "")).otherwise(s)


def genre_family(name: Column) -> Column:
    """The first family one of whose words is contained in the folded name."""
    low = fold(name)
    family = F.lit(NO_FAMILY)
    for label, some in reversed(FAMILIES):
        hit = F.lit(False)
        for w in some:
            hit = hit | (F.instr(low, w) > 0)
        family = F.when(hit, label).otherwise(family)
    return family


def arc_stage(name: Column) -> Column:
    """0 (opening) to 5 (outro) by the words in a tag's name, null if none places it."""
    low = F.lower(F.coalesce(name, F.lit("")))
    stage = F.lit(None).cast("int")
    for i, some in reversed(list(enumerate(STAGES))):
        hit = F.lit(False)
        for w in some:
            hit = hit | (F.instr(low, w) > 0)
        stage = F.when(hit, i).otherwise(stage)
    return stage


def is_branding(text: Column) -> Column:
    """Does a tag hold a web address or the name of a shop? Null is no."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(URL_TEXT) | text.rlike(SHOP_TEXT)


def frame_kind(kind: Column, key: Column, value: Column) -> Column:
    """What a tag of a file is: 'brand', 'album' (a branded album title), 'cover' or '' for what belongs to the music.

    kind: 'MP4' for atoms, anything else for frames and comments. A cover counts only beside a brand, which the caller sees.
    """
    value, junk = F.coalesce(value, F.lit("")), is_branding(value)
    low, base = F.lower(key), F.upper(F.split_part(key, F.lit(":"), F.lit(1)))
    filled = F.trim(value) != ""
    atom = F.when(low == "covr", "cover").when(key.isin("\u00a9cmt", "cprt") & junk, "brand").when((key == "\u00a9alb") & junk, "album").when(F.startswith(key, F.lit("----")) & junk & ~F.contains(low, F.lit("mixedinkey")) & ~F.contains(low, F.lit("serato")), "brand")
    name = F.when(F.contains(low, F.lit(":")), F.substr(low, F.instr(low, ":") + 1)).otherwise(low)
    analysis = F.contains(name, F.lit("serato")) | F.contains(name, F.lit("energy")) | F.contains(name, F.lit("key"))
    said = F.when(analysis, "").when(junk | F.contains(name, F.lit("pool-user")) | F.endswith(name, F.lit("-user")), "brand")
    frame = F.when(base.isin(*KEPT_FRAMES), "").when(base == "APIC", "cover").when(base.isin(*URL_FRAMES) | F.startswith(F.upper(key), F.lit("WXXX")), F.when(filled, "brand")).when((base == "TALB") | (low == "album"), F.when(junk, "album"))
    frame = frame.when((base == "COMM") | (low == "comment"), F.when(junk, "brand")).when(base.isin(*MAYBE_FRAMES) & junk, "brand").when(F.startswith(F.upper(key), F.lit("TXXX")), said)
    frame = frame.when(low.isin("www", "publisher", "mmpool-user") & filled, "brand").when(low.isin("encoded_by", "copyright") & junk, "brand")
    return F.coalesce(F.when(kind == "MP4", atom).otherwise(frame), F.lit(""))


def is_compilation(album: Column, title: Column) -> Column:
    """Does an album's title name a compilation, unless the song is called so?"""
    album = F.coalesce(album, F.lit(""))
    return album.rlike(COMPILATION) & (words(album, compat=True) != words(title, compat=True))


def search_query(title: Column, artist: Column) -> Column:
    """What to look a song up by: the first artist and the title without its version."""
    base = base_title(title, compat=True)
    first = F.get(F.split(F.coalesce(artist, F.lit("")), r"(?i)\s*(?:,|&| feat\.? | ft\.? | x | vs\.? )\s*", 2), F.lit(0))
    return F.trim(F.concat_ws(" ", first, F.when(base == "", F.coalesce(title, F.lit(""))).otherwise(base)))


def unfindable_key(artist: Column, title: Column, query: Column) -> Column:
    """The key under which a song that cannot be found is remembered."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    named = (F.coalesce(title, F.lit("")) != "") | (F.coalesce(artist, F.lit("")) != "")
    return F.when(named, F.concat_ws("\t", plain(artist), plain(title))).otherwise(plain(query))


def quality_label(exists: Column, codec: Column, lossless: Column, rate: Column, depth: Column, bitrate: Column) -> Column:
    """'FLAC 44.1 kHz / 24-bit' of lossless files, 'MP3 320 kbps' of others, as far as it is known."""
    codec = F.coalesce(codec, F.lit("?"))
    khz = F.when(F.coalesce(rate, F.lit(0)) > 0, F.concat(F.replace(F.format_string("%.1f", rate / 1000.0), F.lit(".0"), F.lit("")), F.lit(" kHz")))
    bits = F.when(F.coalesce(depth, F.lit(0)) > 0, F.concat(depth.cast("string"), F.lit("-bit")))
    full = F.concat_ws(" / ", khz, bits)
    kbps = F.bround(F.coalesce(bitrate, F.lit(0)) / 1000.0).cast("int")
    known = F.when(F.coalesce(lossless, F.lit(False)), F.rtrim(F.concat_ws(" ", codec, full))).when(kbps > 0, F.concat(codec, F.lit(" "), kbps.cast("string"), F.lit(" kbps"))).otherwise(codec)
    return F.when(F.coalesce(exists, F.lit(False)), known).otherwise("file not found")


def work_label(tags: Column, cues: Column, comment: Column, rating: Column) -> Column:
    """What work a copy carries, in words: '2 tags, 3 cues, a comment, a rating'."""
    n = F.greatest(F.size(tags), F.lit(0))
    return F.concat_ws(", ", F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " tag").otherwise(" tags"))), F.when(F.coalesce(cues, F.lit(0)) > 0, F.concat(cues.cast("string"), F.lit(" cues"))), F.when(F.coalesce(comment, F.lit("")) != "", "a comment"), F.when(F.coalesce(rating, F.lit(0)) != 0, "a rating"))


def duration_label(seconds: Column) -> Column:
    """m:ss, or a dash for null and zero."""
    s = F.round(seconds).cast("int")
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "—").otherwise(F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60))))


def split_dash(text: Column) -> tuple[Column, Column]:
    """(artist, title) of 'Artist - Title' with any dash between blanks; without one the artist is ''."""
    pattern = r"^(.*?)\s+[-–—]\s+(.*)$"
    hit = text.rlike(pattern)
    return F.when(hit, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(""), F.when(hit, F.trim(F.regexp_extract(text, pattern, 2))).otherwise(F.trim(text))


def file_stem(path: Column) -> tuple[Column, Column]:
    """(artist, title) of a file name like '01. Artist - Title.ext'."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return split_dash(F.regexp_replace(stem, r"^\d{1,3}[\s._-]+", ""))


def safe_name(text: Column, most: int = 150) -> Column:
    """A part of a file name: slashes and colons to dashes, control characters out, blanks squeezed, blanks and dots off the ends."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"[/:\\]", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1f\x7f]", ""), r"\s+", " ")
    return F.substring(F.regexp_replace(s, r"^[ .]+|[ .]+$", ""), 1, most)


def version_parts(text: Column) -> Column:
    """array<int> of 'v1.2.3'; null if it is none. Arrays compare in order."""
    hit = text.rlike(r"^v?\d+(\.\d+)*$")
    return F.when(hit, F.transform(F.split(F.regexp_replace(text, "^v", ""), r"\."), lambda x: x.cast("int")))
