"""Query of the packed-field splitter."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlore.operators.multivalue import ARTISTS, GENRES, split_values
from setlore.tables import load

def genre_grammar(spark: SparkSession, folder: str):
    """The genre grammar with those names of genre_ref that it would cut or turn round: names of one word need no entry."""
    gap = F.lit("(?i)" + GENRES.gap)
    rows = load(spark, folder, "genre_ref").where(F.regexp_like("name", gap) | F.col("name").rlike(r"^\s*\p{L}+\s+\p{L}+\s*$")).select("name").distinct().collect()
    return replace(GENRES, names=tuple(sorted(r[0] for r in rows)))


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Values in quotes and values with a quote that does not close, by field, with one of them."""
    values = split_values(load(spark, folder, "track"), "id", {"genre": genre_grammar(spark, folder), "artist": ARTISTS})
    return values.groupBy("field", "quoted", "malformed").agg(F.count("*").alias("n"), F.min("value").alias("example"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    track = load(spark, folder, "track")
    return split_values(track, "id", {"genre": genre_grammar(spark, folder), "artist": ARTISTS}, several_only=True).select("id", "field", "pos", "value")


QUERIES = {"p2_found": p2_found, "p2_flags": p2_flags}
ORACLES: dict[str, str] = {}
