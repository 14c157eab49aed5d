"""Connected components of a large graph by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved

#: Rounds are logarithmic in the longest path; this many are never needed.
ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b), root being the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones (large star, small
    star), and is written to the shared folder. It ends when every node but the roots has one edge, to a root. Rows of one
    node are only ever aggregated to a minimum or joined with it. The minima are written by themselves, so that Spark
    broadcasts them while they are small, and beyond that each side of a join is a plain exchange, where it splits the
    rows of a node with very many links.
    """
    links = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(ROUNDS):
        if _stars(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.filter("a <> b"))  # at most as many rows as links; what repeats goes below
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = saved(small.filter("a <> b").distinct())
        release(links, low, large, least)
        links = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether no node of ``links`` has both larger and smaller neighbours, or several smaller ones."""
    if not links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
        return False
    return links.groupBy("a").count().filter("count > 1").isEmpty()
