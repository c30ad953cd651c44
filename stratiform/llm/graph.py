"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.session import checkpointed


def _least(links: DataFrame) -> DataFrame:
    """For each end ``a`` its smallest neighbour."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs under one other, and none that others hang under hangs itself."""
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("over"))
    nodes = nodes.unionAll(links.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("over")))
    nodes = nodes.groupBy("node").agg(F.min("over").alias("low"), F.max("over").alias("high"), F.max(F.col("over").isNull()).alias("held"))
    return nodes.where("low <> high or (low is not null and held)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links`` (columns ``a`` and ``b``); the component is its smallest node.

    Alternating large-star and small-star steps hang each node under smaller ones until only stars are left. Steps are
    aggregates and joins on nodes, so a hub's links are combined before they move and skewed joins are split; links stay
    in Spark, and each round is checkpointed.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = checkpointed(links)
    while not _stars(links):
        # Large-star: larger neighbours of a node hang under the smallest of the node and its neighbours.
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        links = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = links.where("a <> b").distinct()
        # Small-star: a node and its smaller neighbours hang under the smallest of them.
        least = _least(links)
        links = links.join(least, "a")
        links = links.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        links = checkpointed(links.select("l.a", "l.b").where("a <> b").distinct())
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
