"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlore.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node with an edge is connected to.

    Smallest labels travel along the edges and by pointer jumping; each round is written to the shared
    folder, and the rounds end when nothing changes, which labels that only fall must reach. No link ever
    leaves the executors: joins are by sorting, as links that are small when stored may be large in memory.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    while True:
        heard = both.hint("merge").join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("heard")).withColumnRenamed("a", "node")
        step = labels.hint("merge").join(heard, "node").select("node", "comp", F.least("comp", "heard").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("root"))
        moved = materialise(step.hint("merge").join(jump, "low", "left").select("node", F.col("comp").alias("old"), F.least("low", F.coalesce("root", "low")).alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels
