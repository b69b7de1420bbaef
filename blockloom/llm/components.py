"""Connected components over a table of links, by alternating large-star and small-star steps.

Every step is aggregations and equi-joins over the links; nothing is gathered on the driver but one number a round. A
node with very many links is summed with partial aggregation, and its join partition is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.shared import checkpoint


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def settled(links: DataFrame) -> bool:
    """Whether the links (a to a smaller b) are stars: every a has one b, and no b is an a."""
    forked = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    passed = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
    return not forked.unionByName(passed).limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) as longs, in any direction and number; gives node and component, the smallest node reachable.

    Nodes without a link to another are left out. A component is labelled by one of its nodes, the smallest. The steps
    end for any links, since every round that changes them moves links to smaller nodes.
    """
    links = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(links):
        links = checkpoint(small_star(large_star(links)))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
