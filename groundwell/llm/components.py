"""Connected components of a table of links, by alternating large and small stars.

Every round is a few joins and groupings over the links that are left; each round's table is written to the shared
folder.  Nothing but one count and one checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    above = both.where("b > a").join(least, "a")
    return above.where("m != b").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of them.  Edges run from a (smaller) to b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    below = edges.join(least, "b").where("a != m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return below.unionByName(own).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node that can be reached.

    Links may come in either direction, repeated or from a node to itself.  Nodes without a link to another node
    are not listed.  No links give no rows.
    """
    edges = settle(links.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        edges = settle(_small_star(_large_star(edges)), "links")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = tuple(mark)
