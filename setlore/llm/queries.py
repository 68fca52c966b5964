"""Queries of the training-data operators and the SQL statements of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlore.llm import canonical_list, cooccurrence, languages, layout_duplicates, mixture, name_variants, survivor, tokenizer, unicode_form
from setlore.session import materialise
from setlore.tables import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = cooccurrence.cooccurrence(load(spark, folder, "track_view"), "tags", min_count=5, min_share=500)
    wide = [F.col(c).cast("decimal(18,0)") for c in ("n_ab", "n", "n_a", "n_b")]
    return found.where(2 * wide[0] * wide[1] >= 5 * wide[2] * wide[3]).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p1_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of tags with its counts and lift."""
    found = cooccurrence.cooccurrence(load(spark, folder, "track_view"), "tags")
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


P1_COUNTS = """
    WITH basket AS (SELECT row_number() OVER () AS r, list_distinct(tags) AS tags FROM track_view),
    item AS (SELECT r, tag FROM (SELECT r, unnest(tags) AS tag FROM basket) WHERE tag IS NOT NULL),
    one AS (SELECT tag, count(*) AS c FROM item GROUP BY tag),
    total AS (SELECT count(DISTINCT r) AS n FROM item),
    pair AS (SELECT a.tag AS item_a, b.tag AS item_b, count(*) AS n_ab FROM item a JOIN item b ON a.r = b.r AND a.tag < b.tag GROUP BY ALL),
    counted AS (SELECT item_a, item_b, n_ab, x.c AS n_a, y.c AS n_b, n FROM pair JOIN one x ON x.tag = item_a JOIN one y ON y.tag = item_b, total)
"""


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = name_variants.pairs(name_variants.variants(load(spark, folder, "track"), "artist"))
    return found.select(F.col("value_a").alias("artist_a"), F.col("value_b").alias("artist_b"))


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    """(id, key, file, tags, comment) of every track: digests of the recording's key and of the path, the number of tags and of letters of the comment."""
    tags = F.size(F.array_distinct(F.filter(F.transform("mytags", lambda t: t["id"]), lambda t: t.isNotNull())))
    comment = F.length(F.regexp_replace(F.coalesce("comment", F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    keyed = layout_duplicates.with_layout_key(load(spark, folder, "track"), "id", ["title", "artist"], keep=["path", "mytags", "comment"])
    return keyed.select("id", survivor.digest(F.col("key")).alias("key"), survivor.digest(F.col("path")).alias("file"), tags.alias("tags"), comment.alias("comment"))


def _bitrate() -> Column:
    return F.coalesce(F.col("bitrate").cast("double"), F.try_divide(F.col("size") * 8.0, F.col("duration")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    there = load(spark, folder, "probe").where("exists and path is not null").select(survivor.digest(F.col("path")).alias("file"), F.coalesce("lossless", F.lit(False)).alias("lossless"), _bitrate().alias("rate"))
    # of repeated probe rows the best lossless one, else the best one
    files = there.groupBy("file").agg(F.max(F.col("lossless").cast("int")).alias("lossless"), F.max(F.when(F.col("lossless"), F.col("rate"))).alias("full"), F.max("rate").alias("rate"))
    files = files.select("file", "lossless", F.when(F.col("lossless") == 1, F.col("full")).otherwise(F.col("rate")).alias("rate"))
    rows = _copies(spark, folder).join(files, "file", "left")
    bundles = [
        survivor.Bundle("audio", F.col("lossless").isNotNull(), (F.col("lossless"), F.col("rate"))),
        survivor.Bundle("mytags", F.col("tags") > 0, (F.col("tags"),)),
        survivor.Bundle("comment", F.col("comment") > 0, (F.col("comment"),)),
    ]
    return survivor.survivors(rows, F.col("key"), "id", bundles)


def p4_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """The best format, sample rate and bitrate of every recording such that format and rate, and format and bitrate, stand together in some copy whose file exists."""
    columns = (F.coalesce("codec", F.lit("")).alias("codec"), F.coalesce("lossless", F.lit(False)).alias("lossless"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("rate", F.lit(0)).alias("rate"), F.floor(F.coalesce(_bitrate(), F.lit(0.0))).alias("bitrate"))
    there = load(spark, folder, "probe").where("exists and path is not null").select(survivor.digest(F.col("path")).alias("file"), F.struct(*columns).alias("m"))
    rows = _copies(spark, folder).select("id", "key", "file").join(there.groupBy("file").agg(F.max("m").alias("m")), "file", "left").select("id", "key", "m.*")
    have = F.col("codec").isNotNull()
    bundles = [
        survivor.Bundle("format", have, (F.col("lossless"), F.col("depth")), {"codec": F.col("codec")}),
        survivor.Bundle("rate", have, (F.col("rate"),), {"rate": F.col("rate")}),
        survivor.Bundle("bitrate", have, (F.col("bitrate"),), {"bitrate": F.col("bitrate")}),
    ]
    return survivor.survivors(materialise(rows), F.col("key"), "id", bundles, [("format", "codec", "rate", "rate"), ("format", "codec", "bitrate", "bitrate")])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    genre = load(spark, folder, "genre_ref").select(F.col("genre_id").alias("entry"), "name")
    key = load(spark, folder, "key_ref").select(F.col("key_id").alias("entry"), "camelot", "scale_name")
    keys = load(spark, folder, "track").select("id", F.lit("key").alias("field"), F.lit(1).alias("pos"), F.col("key").alias("value"))
    genres = load(spark, folder, "track_view").select("id", F.lit("genres").alias("field"), F.posexplode("genres").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
    exact = genre.select(F.col("name").alias("value")).union(key.select("camelot")).union(key.select("scale_name")).distinct()
    rows = keys.unionByName(genres).where("value is not null and value <> ''").join(exact, "value", "left_anti")
    return canonical_list.map_values(rows, genre, key)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return unicode_form.clean_text(load(spark, folder, "track"), "id", ["title", "artist", "color"], changed_only=True).select("id", "field")


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the three fields in its consistent form."""
    return unicode_form.clean_text(load(spark, folder, "track"), "id", ["title", "artist", "color"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_duplicates.pairs(load(spark, folder, "track"), "id", ["title", "artist"])


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row a recording with two or more copies: its smallest id and the number of copies."""
    return layout_duplicates.copies(load(spark, folder, "track"), "id", ["title", "artist"])


P7_KEYS = r"""
    WITH part AS (SELECT id, regexp_replace(replace(lower(upper(nfc_normalize(coalesce(title, '')))), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS t,
        regexp_replace(replace(lower(upper(nfc_normalize(coalesce(artist, '')))), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS a FROM track),
    keyed AS (SELECT id, least(t, a) AS k1, greatest(t, a) AS k2 FROM part WHERE regexp_matches(t, '[\p{L}\p{N}]') AND regexp_matches(a, '[\p{L}\p{N}]'))
"""

def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(load(spark, folder, "documents"), "doc_id", "text")


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(tokenizer.count_tokens(load(spark, folder, "documents").where("source is not null"), "text", ["doc_id", "source"]))


def _mixed(spark: SparkSession, folder: str, **how: float) -> DataFrame:
    return mixture.mix(_counted(spark, folder), "doc_id", "source", "n_tokens", load(spark, folder, "source_target"), **how)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(_mixed(spark, folder), load(spark, folder, "source_target"))


def p9_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mixture as large as all texts together: more than the targets allow, so the exponent is bisected until the caps hold."""
    counted, targets = _counted(spark, folder), load(spark, folder, "source_target")
    total = counted.agg(F.sum("n_tokens")).first()[0]
    return mixture.shares(mixture.mix(counted, "doc_id", "source", "n_tokens", targets, total=float(total or 0)), targets)


def p9_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mixture whose source weights are the token shares raised to the power that gives 1.5 nats."""
    return mixture.shares(_mixed(spark, folder, nats=1.5), load(spark, folder, "source_target"))


def _segments(spark: SparkSession, folder: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, folder, "documents")
    profiles = languages.fit(languages.sample(documents, "doc_id", "text", "lang"))
    return languages.segments(documents, "doc_id", "text", profiles, every), documents


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    found, documents = _segments(spark, folder)
    found = materialise(found.select("doc_id", "seg", "lang"))  # it is read twice
    labels = documents.select("doc_id", F.col("lang").alias("label"))
    told = found.groupBy("doc_id").agg(F.min("lang").alias("low"), F.max("lang").alias("high")).join(labels, "doc_id")
    right = told.where((F.col("low") == F.col("high")) & (F.col("label") == F.col("low"))).select("doc_id")
    return found.join(right, "doc_id", "left_anti")


def p10_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document with its confidence; 'und' with confidence 0 where it has no sentence."""
    return languages.documents(_segments(spark, folder, every=True)[0], "doc_id")


P4_TRIM = r"regexp_replace(coalesce(comment, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
P4_SQL = P7_KEYS + f""",
    member AS (SELECT *, min(id) OVER (PARTITION BY k1, k2) AS group_id, count(*) OVER (PARTITION BY k1, k2) AS n FROM keyed),
    file AS (SELECT DISTINCT path, "exists", size, duration, bitrate, lossless FROM probe),
    copy AS (SELECT m.group_id, t.id, len(list_distinct(list_transform(mytags, lambda x: x.id))) AS tags, length({P4_TRIM}) AS chars,
        f."exists", coalesce(f.lossless, false) AS lossless, coalesce(f.bitrate, f.size * 8.0 / nullif(f.duration, 0)) AS rate
        FROM member m JOIN track t ON t.id = m.id LEFT JOIN file f ON f.path = t.path WHERE m.n > 1)
    SELECT group_id, 'audio' AS field, id FROM copy WHERE "exists" QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY lossless DESC, rate DESC NULLS LAST, id) = 1
    UNION ALL SELECT group_id, 'mytags', id FROM copy WHERE tags > 0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY tags DESC, id) = 1
    UNION ALL SELECT group_id, 'comment', id FROM copy WHERE chars > 0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY chars DESC, id) = 1
"""

P4_BUNDLES = P7_KEYS + """,
    member AS (SELECT *, min(id) OVER (PARTITION BY k1, k2) AS group_id, count(*) OVER (PARTITION BY k1, k2) AS n FROM keyed),
    file AS (SELECT path, max({'codec': coalesce(codec, ''), 'lossless': coalesce(lossless, false), 'depth': coalesce(depth, 0), 'rate': coalesce(rate, 0), 'bitrate': floor(coalesce(bitrate, size * 8.0 / nullif(duration, 0), 0))}) AS m FROM probe WHERE "exists" GROUP BY path),
    copy AS (SELECT m.group_id, t.id, f.m.codec AS codec, f.m.lossless AS lossless, f.m.depth AS depth, f.m.rate AS rate, f.m.bitrate AS bitrate FROM member m JOIN track t ON t.id = m.id JOIN file f ON f.path = t.path WHERE m.n > 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY lossless DESC, depth DESC, id) AS r FROM (SELECT * FROM copy QUALIFY row_number() OVER (PARTITION BY group_id, codec ORDER BY lossless DESC, depth DESC, id) = 1)),
    s AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY rate DESC, id) AS r FROM (SELECT * FROM copy QUALIFY row_number() OVER (PARTITION BY group_id, rate ORDER BY id) = 1)),
    b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY bitrate DESC, id) AS r FROM (SELECT * FROM copy QUALIFY row_number() OVER (PARTITION BY group_id, bitrate ORDER BY id) = 1)),
    choice AS (SELECT f.group_id, f.id AS fid, s.id AS sid, b.id AS bid FROM f JOIN s USING (group_id) JOIN b USING (group_id)
        WHERE EXISTS (SELECT 1 FROM copy c WHERE c.group_id = f.group_id AND c.codec = f.codec AND c.rate = s.rate) AND EXISTS (SELECT 1 FROM copy c WHERE c.group_id = f.group_id AND c.codec = f.codec AND c.bitrate = b.bitrate)
        QUALIFY row_number() OVER (PARTITION BY f.group_id ORDER BY f.r + s.r + b.r, f.r, s.r, b.r) = 1)
    SELECT group_id, 'format' AS field, fid AS id FROM choice UNION ALL SELECT group_id, 'rate', sid FROM choice UNION ALL SELECT group_id, 'bitrate', bid FROM choice
"""

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_bundles": p4_bundles, "p5_found": p5_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_capped": p9_capped, "p9_entropy": p9_entropy, "p10_found": p10_found, "p10_documents": p10_documents, "p1_found": p1_found, "p1_lift": p1_lift, "p6_found": p6_found, "p6_clean": p6_clean, "p7_found": p7_found, "p7_copies": p7_copies}
ORACLES = {
    "p4_found": P4_SQL,
    "p4_bundles": P4_BUNDLES,
    "p1_found": P1_COUNTS + "SELECT item_a AS tag_a, item_b AS tag_b FROM counted WHERE n_ab >= 5 AND 500 * n_ab >= n AND 2 * n_ab::HUGEINT * n >= 5 * n_a::HUGEINT * n_b",
    "p1_lift": P1_COUNTS + "SELECT item_a, item_b, n_ab, n_a, n_b, n, round(n_ab * n::DOUBLE / (n_a::DOUBLE * n_b), 6) AS lift FROM counted",
    "p7_found": P7_KEYS + "SELECT a.id AS id_a, b.id AS id_b FROM keyed a JOIN keyed b ON a.k1 = b.k1 AND a.k2 = b.k2 AND a.id < b.id",
    "p7_copies": P7_KEYS + "SELECT min(id) AS group_id, count(*) AS copies FROM keyed GROUP BY k1, k2 HAVING count(*) > 1",
}
