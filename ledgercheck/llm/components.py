"""Connected components of a table of links, by alternating large and small stars.

Every round is two shuffles on a table of about the size of the links, written to the shared
folder; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.llm.common import discard, settled


def _links(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (u, v); the component is its least node."""
    now = settled(_links(links), "links")
    while True:
        # large star: every larger neighbour of u to the least of u and its neighbours
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = settled(_links(both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        # small star: u and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        following = settled(_links(small), "small")
        discard(now, large)
        now = following
        if _are_stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one least node that has none itself: then it is the component's."""
    ends = links.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("other"))
    open_ones = ends.where("v <> other").select("u").union(
        links.select(F.col("v").alias("u")).join(ends.select("u"), "u", "left_semi"))
    return open_ones.isEmpty()
