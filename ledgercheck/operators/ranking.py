"""Positions within groups that may be large."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_in_group(
    df: DataFrame, group: list[str], order: list[str], settle: Callable[[DataFrame, str], DataFrame],
    name: str,
) -> DataFrame:
    """Add `position` (from 1) within each group, in the given order.

    A window would bring a whole group to one task.  Here all rows are sorted by range
    over group and order, so that a large group is spread, and written once; the position
    follows from the place in the partition, the rows in the partitions before, and the
    first place of the group.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    placed = settle(
        df.orderBy(*keys).select("*", F.spark_partition_id().alias("_part"),
                                 F.monotonically_increasing_id().alias("_place")),
        name,
    )
    # one row per partition: a table of the size of the job, not of the data
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift")
    )
    indexed = placed.join(offsets, "_part").withColumn("_index", F.col("_place") + F.col("_shift"))
    first = indexed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(
        F.min("_index").alias("_first"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return indexed.join(first, same).select(
        *df.columns, (F.col("_index") - F.col("_first") + 1).alias("position")
    )
