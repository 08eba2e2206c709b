"""Connected components of a table of links, by alternating large and small stars.

Every round is an aggregate and a join over the links; nothing but two sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import keep


def _star(links: DataFrame) -> DataFrame:
    """Every node of (a, b) joined to the least node beside it, itself included."""
    return links.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node reachable.

    Links are undirected; repeated links and links of a node to itself do no harm. The number
    of rounds grows with the logarithm of the longest path. A node with very many links is
    one aggregate row, and the join on it can be split, as one side has one row per node.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = keep(links, name)
    while not _are_stars(links):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_star(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = large.join(_star(large), "a")
        ends = F.explode(F.array("a", "b")).alias("a")
        links = keep(small.select(ends, F.col("least").alias("b")).filter("a != b").distinct(), name)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether every node points to one node, and that one to none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("n")).unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("n")))
    per = ends.groupBy("node").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return per.filter("n > 1 or (n = 1 and least = 0)").isEmpty()
