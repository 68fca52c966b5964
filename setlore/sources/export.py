"""Exports: every table as compressed JSON lines, a collection as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dump_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table under its name as gzip-compressed JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}", compression="gzip", ignoreNullFields=False)


def collection_xml(track: DataFrame, folder: str) -> None:
    """Tracks as XML elements, one file a partition; attributes begin with an underscore as Spark's writer wants them."""
    flat = track.selectExpr("id AS _id", "title AS _title", "artist AS _artist", "path AS _path", "genre AS _genre", "key AS _key", "bpm AS _bpm", "rating AS _rating", "mytags.name AS tag", "playlists.name AS playlist")
    flat.write.mode("overwrite").format("xml").option("rootTag", "collection").option("rowTag", "track").save(folder)
