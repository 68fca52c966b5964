"""Free-entered values mapped to a reference list by a prefix-filtered set-similarity join.

Values and reference spellings become sets of tokens (letters with their count, pairs of neighbouring
letters, and whole parts that must agree). Tokens are ordered by global rarity; two sets of Jaccard
similarity t can only meet if they share a token among their first n - ceil(t n) + 1 rarest ones, so
only these prefixes are joined. Length and position filters follow, Jaccard is verified exactly, an
exact edit check confirms, and the best entry is kept. All of it runs on distinct values, in the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlore.session import materialise

THRESHOLD = 0.4
# Note names by pitch, sharp and flat and their look of sign.
PITCHES = (("c", "b#"), ("c#", "db"), ("d",), ("d#", "eb"), ("e", "fb"), ("f", "e#"), ("f#", "gb"), ("g",), ("g#", "ab"), ("a",), ("a#", "bb"), ("b", "cb"))
# Words for the two modes.
MODES = {"minor": ("m", "min", "minor", "menor", "mineur", "minore", "moll"), "major": ("", "maj", "major", "mayor", "majeur", "maggiore", "dur")}
# Short forms of genre words and names.
GENRE_WORDS = (("hse", "house"), ("prog", "progressive"), ("new", "nu"), ("ost", ""), ("o s t", ""), ("u k", "uk"))
GENRE_SHORT = {"drumbass": ("dnb", "db", "dandb", "drumandbass", "drumnbass"), "rb": ("rnb", "randb"), "ukgarage": ("ukg",), "hiphop": ("hh",), "soundtrack": ("ost",)}


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents, by a table that the decomposition rule gives."""
    table = {}
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and plain[0].isascii():
            table[chr(code)] = plain[0]
    return F.regexp_replace(F.translate(text, "".join(table), "".join(table.values())), r"\p{M}", "")


def genre_words(text: Column) -> Column:
    """Lower case words of letters and digits, one blank between, joining words and short forms resolved."""
    t = F.regexp_replace(fold_accents(F.lower(text)), r"(?<=[\s'\p{L}])(?:'n'|&)(?=[\s\p{L}])|\s+(?:and|n)\s+", " ")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    for short, full in GENRE_WORDS:
        t = F.trim(F.regexp_replace(t, rf"\b{short}\b", full))
    return t


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def turned(text: Column) -> Column:
    """'Jazz, Latin' and 'Rock (Indie)' with the parts in the usual order, else null."""
    return F.when(text.rlike(r"^\s*\p{L}+\s*(,\s*\p{L}+|[(\[]\s*\p{L}+\s*[)\]])\s*\.?\s*$"), F.regexp_replace(text, r"^\s*(\p{L}+)[\s,(\[]+(\p{L}+).*$", "$2 $1"))


def letter_tokens(text: Column) -> Column:
    """Each letter with its count so far, and each pair of neighbours with the ends marked."""
    n = F.length(text)
    letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(text.substr(i, F.lit(1)), (F.length(text.substr(F.lit(1), i)) - F.length(F.replace(text.substr(F.lit(1), i), text.substr(i, F.lit(1)), F.lit("")))).cast("string")))
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    counted = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.concat(framed.substr(i, F.lit(2)), F.lit("|"), (F.length(framed.substr(F.lit(1), i + 1)) - F.length(F.replace(framed.substr(F.lit(1), i + 1), framed.substr(i, F.lit(2)), F.lit("")))).cast("string")))
    return F.when(n > 0, F.concat(letters, counted)).otherwise(F.array().cast("array<string>"))


def key_parts(text: Column) -> Column:
    """struct(kind, root, mode): kind 'camelot' with the code, 'scale' with note and mode word, or ''."""
    t = F.regexp_replace(F.replace(F.replace(F.trim(F.regexp_replace(text, r"[\s\p{Zs}]+", " ")), F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("b")), r"(?i)^key\s+|[.\s]+$", "")
    code = r"^0*([1-9]|1[0-2])\s*([ABabMm])$"
    letter = F.regexp_extract(t, code, 2)
    camelot = F.concat(F.regexp_extract(t, code, 1), F.when(letter == "m", "a").when(letter == "M", "b").otherwise(F.lower(letter)))
    scale = r"(?i)^([A-G](?:#|b(?=[md\s-]|$))?)[\s-]*([a-z]*)$"
    none = F.struct(F.lit("").alias("kind"), F.lit("").alias("root"), F.lit("").alias("mode"))
    return F.when(t.rlike(code), F.struct(F.lit("camelot").alias("kind"), camelot.alias("root"), F.lit("").alias("mode"))).when(
        t.rlike(scale), F.struct(F.lit("scale").alias("kind"), F.lower(F.regexp_extract(t, scale, 1)).alias("root"), F.lower(F.regexp_extract(t, scale, 2)).alias("mode"))
    ).otherwise(none)


def with_tokens(df: DataFrame) -> DataFrame:
    """Adds tokens from (field, part, spelling): the part as one token that must agree, then the spelling's letters."""
    part = F.when(F.col("part") != "", F.array(F.concat(F.lit("="), "part"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("tokens", F.concat(part, letter_tokens(F.col("spelling"))))


def genre_spellings(reference: DataFrame) -> DataFrame:
    """(field, entry, part, spelling) of (entry, name): the name, and its short forms."""
    base = reference.select("entry", squeezed(genre_words(F.col("name"))).alias("spelling"))
    spark = reference.sparkSession
    short = spark.createDataFrame([(k, s) for k, v in GENRE_SHORT.items() for s in v], "spelling string, short string")
    extra = base.join(F.broadcast(short), "spelling").select("entry", F.col("short").alias("spelling"))
    return base.unionByName(extra).distinct().select(F.lit("genres").alias("field"), "entry", F.lit("").alias("part"), "spelling")


def key_spellings(spark: SparkSession, reference: DataFrame) -> DataFrame:
    """(field, entry, part, spelling) of (entry, camelot, scale_name): the code, and each note name of the pitch with each mode word."""
    names = [(n, other, mode, word) for same in PITCHES for n in same for other in same for mode, words in MODES.items() for word in words]
    table = spark.createDataFrame(names, "note string, other string, mode string, word string")
    scale = F.lower("scale_name")
    noted = reference.select("entry", F.regexp_extract(scale, r"^([a-g][#b]?)(m?)$", 1).alias("note"), F.when(F.regexp_extract(scale, r"^([a-g][#b]?)(m?)$", 2) == "m", "minor").otherwise("major").alias("mode"))
    scales = noted.join(F.broadcast(table), ["note", "mode"]).select("entry", F.col("other").alias("part"), F.col("word").alias("spelling"))
    codes = reference.select("entry", F.lower("camelot").alias("part"), F.lit("").alias("spelling"))
    return codes.unionByName(scales).select(F.lit("key").alias("field"), "entry", "part", "spelling")


def _ordered(df: DataFrame, key: list[str], order: DataFrame) -> DataFrame:
    """df with its tokens sorted by (global count, token)."""
    return df.select(*key, F.explode(F.array_distinct("tokens")).alias("token")).join(order, "token").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("sorted")).select(*key, F.col("sorted.token").alias("tokens"))


def similarity_join(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(field, vid, entry, jaccard, spelling, ref_spelling) of every pair with Jaccard >= threshold in one field.

    values: field, vid, spelling, tokens, one row a vid; reference: field, entry, rid, spelling, tokens, one row a rid.
    """
    both = values.select(F.explode(F.array_distinct("tokens")).alias("token")).unionByName(reference.select(F.explode(F.array_distinct("tokens")).alias("token")))
    order = both.groupBy("token").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, key: list[str], name: str) -> DataFrame:
        n = F.size("tokens")
        take = n - F.ceil(F.lit(threshold) * n).cast("int") + 1
        p = _ordered(df, key, order).select(*key, F.col("tokens").alias(f"{name}_tokens"), n.alias(f"{name}_n"), F.posexplode(F.slice("tokens", F.lit(1), take)).alias(f"{name}_at", "token"))
        return p

    left, right = prefix(values, ["field", "vid", "spelling"], "v"), prefix(reference.withColumnRenamed("spelling", "ref_spelling"), ["field", "entry", "rid", "ref_spelling"], "r")
    vn, rn = F.col("v_n"), F.col("r_n")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (vn + rn) - F.lit(1e-9))
    met = left.join(right, ["field", "token"]).where((vn >= threshold * rn) & (rn >= threshold * vn) & (1 + F.least(vn - F.col("v_at") - 1, rn - F.col("r_at") - 1) >= need))
    once = met.groupBy("field", "vid", "rid").agg(F.first(F.struct("entry", "spelling", "ref_spelling", "v_tokens", "r_tokens")).alias("m")).select("field", "vid", "m.*")
    shared = F.size(F.array_intersect("v_tokens", "r_tokens"))
    return once.withColumn("jaccard", shared / (F.size("v_tokens") + F.size("r_tokens") - shared)).where(F.col("jaccard") >= threshold).drop("v_tokens", "r_tokens")


def slips(a: Column, b: Column, most: int = 3) -> Column:
    """Edit distance with a swap of neighbours counted once, exact up to one swap; most + 1 for anything beyond `most`."""
    lev = F.levenshtein(a, b, most)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, F.length(a))) == b)
    return F.when(lev < 0, most + 1).when((lev == 2) & (F.length(a) == F.length(b)) & swap, 1).otherwise(lev)


def map_values(values: DataFrame, genre_ref: DataFrame, key_ref: DataFrame) -> DataFrame:
    """(id, field, pos, entry) for each row (id, field, pos, value): the entry meant, or 0 for none.

    field 'key' is compared with key_ref (entry, camelot, scale_name), field 'genres' with genre_ref
    (entry, name). A key is a Camelot code (m, M for A, B) or a note with a mode word, the note exactly
    and the word with one slip of typing; a genre may differ in case, blanks, punctuation, accents, short
    forms, order around a comma or bracket, and one slip (two from twelve letters on). Of several entries
    the highest Jaccard similarity wins, then fewer slips, then the smaller entry.

    Null and empty values give no row; blank ones give 0. Repeated rows stay. Long values are compared
    whole. Empty tables give an empty result. Further columns are not read.
    """
    spark = values.sparkSession
    rows = values.select("id", "field", "pos", "value").where("value is not null and value <> ''")
    distinct = rows.select("field", "value").distinct()
    parts = key_parts(F.col("value"))
    plain = squeezed(genre_words(F.coalesce(turned(F.col("value")), F.col("value"))))
    spelled = distinct.withColumn("k", F.when(F.col("field") == "key", parts)).select(
        "field", "value", F.coalesce("k.root", F.lit("")).alias("part"), F.when(F.col("field") == "key", F.coalesce("k.mode", F.lit(""))).otherwise(plain).alias("spelling")
    )
    spelled = materialise(spelled.withColumn("vid", F.concat_ws("\x1f", "part", "spelling")))
    reference = genre_spellings(genre_ref).unionByName(key_spellings(spark, key_ref)).distinct().withColumn("rid", F.concat_ws("\x1f", "entry", "part", "spelling"))
    reference = with_tokens(reference)
    # a spelling more than two letters longer than every reference spelling has more slips than are allowed
    longest_name = reference.agg(F.max(F.length("spelling"))).first()[0] or 0
    fits = (F.length("spelling") <= longest_name + 2) & ((F.col("part") != "") | (F.col("spelling") != ""))
    cut = with_tokens(spelled.where(fits).select("field", "vid", "part", "spelling").distinct())
    met = similarity_join(cut, reference)
    wrong = slips(F.col("spelling"), F.col("ref_spelling"))
    longest = F.greatest(F.length("spelling"), F.length("ref_spelling"))
    allowed = F.when(F.col("field") == "key", F.when(longest >= 3, 1).otherwise(0)).otherwise(F.when(longest >= 12, 2).when(F.length("ref_spelling") >= 4, 1).otherwise(0))
    same_part = (F.col("field") != "key") | (F.split_part("vid", F.lit("\x1f"), F.lit(1)) == F.col("ref_part"))
    met = met.join(reference.select("field", F.col("entry"), F.col("spelling").alias("ref_spelling"), F.col("part").alias("ref_part")), ["field", "entry", "ref_spelling"])
    best = met.where(same_part).withColumn("wrong", wrong).where(F.col("wrong") <= allowed).groupBy("field", "vid").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "wrong", "entry")).alias("best"))
    mapping = spelled.join(best.select("field", "vid", F.col("best.entry").alias("entry")), ["field", "vid"]).select("field", "value", "entry")
    return rows.join(mapping, ["field", "value"], "left").select("id", "field", "pos", F.coalesce("entry", F.lit(0)).cast("int").alias("entry"))
