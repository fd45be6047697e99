"""Clusters of linked keys, by contraction.

Every round each key hooks on to its least neighbour, chains of hooks are followed to their ends
by doubling, and the links are carried over to the ends; links within an end go.  A table of links
at least halves its keys in a round, so the rounds grow with the logarithm of the keys.  The end
of every cluster is its least key.  Each round is a few shuffles of tables as large as what is
left, written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Settle = Callable[[DataFrame, str], DataFrame]


def _sorted(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def clusters(links: DataFrame, settle: Settle, name: str = "clusters") -> DataFrame:
    """(key, cluster) of every key that has a link (u, v); the cluster is its least key."""
    now = settle(_sorted(links), f"{name}-links-0")
    found, turn = None, 0
    while not now.isEmpty():
        turn += 1
        hooks = now.union(now.select("v", "u")).toDF("key", "other").groupBy("key").agg(
            F.least(F.min("other"), F.col("key")).alias("end"))
        ends = settle(_followed(settle(hooks, f"{name}-hooks-{turn}"), settle,
                                f"{name}-ends-{turn}"), f"{name}-round-{turn}")
        step = ends.toDF("cluster", "following")
        found = settle(ends.toDF("key", "cluster") if found is None else found.join(
            step, "cluster", "left").select("key", F.coalesce("following", "cluster").alias(
                "cluster")), f"{name}-found-{turn}")
        carried = now.join(ends.toDF("u", "u_end"), "u").join(ends.toDF("v", "v_end"), "v")
        now = settle(_sorted(carried.select(F.col("u_end").alias("u"), F.col("v_end").alias("v"))),
                     f"{name}-links-{turn}")
    return now.toDF("key", "cluster") if found is None else found


def _followed(hooks: DataFrame, settle: Settle, name: str) -> DataFrame:
    """Every key with the end of its chain of hooks."""
    turn = 0
    while True:
        next_hop = hooks.toDF("end", "further")
        longer = settle(hooks.join(next_hop, "end", "left").select(
            "key", F.coalesce("further", "end").alias("end"),
            (F.col("further") < F.col("end")).alias("moved")), f"{name}-{turn}")
        if longer.where("moved").isEmpty():
            return longer.select("key", "end")
        hooks, turn = longer.select("key", "end"), turn + 1


def summary(links: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """Per cluster: keys, links, and the least and greatest label of its links."""
    sizes = found.groupBy("cluster").agg(F.count("*").alias("members"))
    of_links = links.join(found.withColumnRenamed("key", "u"), "u").groupBy("cluster").agg(
        F.count("*").alias("links"), F.min(label).alias("strongest"),
        F.max(label).alias("weakest"))
    return sizes.join(of_links, "cluster")
