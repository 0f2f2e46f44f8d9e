"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a long, b long): nodes have one root if and only if links join them.

    In each round every node turns to the neighbour, or itself, of least hash for that round; links between the nodes
    that were turned to go on to the next round, until none is left. A round leaves a constant share of the nodes on
    average, whatever the order of their numbers. No node's links are collected: least neighbours are aggregated
    before they are shuffled, and the joins are of checkpointed tables, where Spark splits the links of large hubs.
    Links with nulls are left out; links of a node with itself give that node as its own root.
    """
    links = cut(links.where("a is not null and b is not null").select("a", "b").distinct())
    found = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root"))
    found = cut(found)
    links = links.where("a <> b")
    turn = 0
    while not links.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        both = links.select("a", "b").union(links.select("b", "a"))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        to = cut(to.select("a", F.least("least", rank("a"))["to"].alias("to")))
        ends = lambda c: to.select(F.col("a").alias(f"{c}_"), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        half = cut(links.join(ends("a"), F.col("a") == F.col("a_")).select("a_to", "b"))
        links = half.join(ends("b"), F.col("b") == F.col("b_")).select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = cut(found.join(ends("a"), F.col("root") == F.col("a_"), "left").select("node", F.coalesce("a_to", "root").alias("root")))
    return found
