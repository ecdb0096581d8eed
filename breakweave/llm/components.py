"""Connected components by contracting edges towards smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every end of an edge; label is the smallest id that can be reached. edges: a, b.

    In each round every id joins its smallest neighbour, two steps at once, and edges move along; those inside
    one label go. All grouping is by minimum, so a hub is merged before it is shuffled.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = scratch.save(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("up"))
        to = scratch.save(to, "step")
        twice = to.join(to.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", "top")
        to = scratch.save(twice, "jump")
        labels = scratch.save(labels.join(to.select(F.col("id").alias("label"), "top"), "label", "left").select("id", F.coalesce("top", "label").alias("label")), "labels")
        moved = edges.join(to.select(F.col("id").alias("a"), F.col("top").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("top").alias("y")), "b")
        edges = scratch.save(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    return labels
