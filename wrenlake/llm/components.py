"""Connected components of a graph of links, by alternating large and small stars.

Each round is two self-joins on the links, in which nodes of many links stay where they are; no adjacency list is
gathered, and each star's links are stored.  Rounds end when neither star changes the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stash


def large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return join_hot(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its least neighbour; here every link goes from larger to smaller."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_hot(down, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def fingerprint(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``a`` and ``b``, its component's least node, for every node that isn't the least itself.

    ``links`` has two integer columns ``a`` and ``b``; links to oneself and nulls are left out.
    """
    links = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = fingerprint(links)
    while True:
        links = stash(small_star(stash(large_star(links), "links")), "links")
        now = fingerprint(links)
        if now == before:
            return links
        before = now
