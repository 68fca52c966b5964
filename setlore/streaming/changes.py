"""The change log and plays as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlore.operators.journal import compact


def compact_stream(log: DataFrame, path: str, checkpoint: str, name: str):
    """Runs the compaction of a streamed change log: one state row a (track, field), emitted when it changes.

    The batch operator is an aggregate without ordering across rows, so the same expression holds its state
    incrementally. Each micro-batch of changed rows is written under `path`.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return compact(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).queryName(name).foreachBatch(write).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, key, n): events by tumbling window; rows later than the watermark are left out. An extension of the library's own queries."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")
