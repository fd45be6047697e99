"""From run to run: what changed, how good the data are, and which rules have earned tier A.

Review decisions are kept in a versioned table below a shared folder.  A version is written whole
under a new number and counts once it is complete, so a run that breaks off leaves the state as it
was.  Upserts keep, per key, the row with the greatest order; ties go to the greater row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = 50          # decisions a rule needs
CONFIRMED = 99      # per cent of them that must be confirmed
POINTS = {"critical": 40, "high": 20, "medium": 10, "low": 5}


class Versions:
    """A table kept from run to run, one folder per version."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def complete(self) -> list[int]:
        """Numbers of the versions that were written to their end."""
        path = self._path(f"{self.folder}/v=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def read(self, number: int | None = None) -> DataFrame:
        """A version, the latest unless told otherwise; no rows before the first."""
        known = self.complete()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(
            f"{self.folder}/v={known[-1] if number is None else number}")

    def upsert(self, rows: DataFrame, key: list[str], order: str) -> DataFrame:
        """Write the next version: old and new rows, per key the one with the greatest order."""
        old = self.read()
        columns = old.columns
        rest = [c for c in columns if c not in key and c != order]
        both = old.unionByName(rows.select(*columns))
        newest = both.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_row")).select(
            *[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in columns])
        number = (self.complete() or [0])[-1] + 1
        # a version that a broken run left unfinished is written over
        newest.write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        return self.read(number)


DECIDED = "finding_id string, rule_id string, confirmed boolean, decided_at timestamp"


def rule_record(decided: DataFrame) -> DataFrame:
    """Per rule: cases, confirmed ones, and whether the rule has earned tier A."""
    counts = decided.groupBy("rule_id").agg(
        F.count("*").alias("cases"), F.count_if("confirmed").alias("confirmed"))
    return counts.withColumn("earned", (F.col("cases") >= CASES)
                             & (F.col("confirmed") * 100 >= F.col("cases") * CONFIRMED))


def with_earned_tiers(found: DataFrame, record: DataFrame) -> DataFrame:
    """Findings whose tier follows the record: A where earned, else B at most.  Bank data (damage
    class 1) and decisions without a proposal keep theirs, as does anything in tier C."""
    earned = found.join(record.select("rule_id", "earned"), "rule_id", "left")
    may = (F.col("damage_class") != 1) & F.col("tier").isin("A", "B")
    return earned.withColumn("tier", F.when(may, F.when(
        F.coalesce("earned", F.lit(False)), F.lit("A")).otherwise(F.lit("B"))).otherwise(
        F.col("tier"))).drop("earned").select(found.columns)


def delta(before: DataFrame, now: DataFrame, compared: list[str]) -> DataFrame:
    """finding_id, rule_id, change (new, gone, changed, same) and the compared columns that differ."""
    columns = ["finding_id", "rule_id", *compared]
    old = before.select([F.col(c).alias(f"old_{c}") for c in columns])
    both = now.select(columns).join(old, F.col("finding_id") == F.col("old_finding_id"),
                                    "full_outer")
    differs = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in compared]))
    change = (F.when(F.col("old_finding_id").isNull(), F.lit("new"))
              .when(F.col("finding_id").isNull(), F.lit("gone"))
              .when(F.size(differs) > 0, F.lit("changed")).otherwise(F.lit("same")))
    return both.select(
        F.coalesce("finding_id", "old_finding_id").alias("finding_id"),
        F.coalesce("rule_id", "old_rule_id").alias("rule_id"), change.alias("change"),
        F.when(change == "changed", F.array_join(differs, ",")).alias("differs"))


def _points() -> Column:
    table = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("severity")), F.lit(0))


def partner_points(found: DataFrame) -> DataFrame:
    """Per partner and category: points, each rule once, 100 at most."""
    once = found.select(F.col("entity.bp_key").alias("bp_key"), "category", "rule_id",
                        "severity").groupBy("bp_key", "category", "rule_id").agg(
        F.max(_points()).alias("points"))
    return once.groupBy("bp_key", "category").agg(
        F.least(F.sum("points"), F.lit(100)).cast("int").alias("points"))


def weights(relevance: DataFrame) -> DataFrame:
    """What a partner weighs: money open and moved, and one unit so that none weighs nothing."""
    return relevance.select("bp_key", (
        F.abs("open_items_local") + F.abs("volume_12m_local") + 1).alias("weight"))


def partner_scores(found: DataFrame) -> DataFrame:
    """Partners with findings: 100 less the points of all categories, 0 at least."""
    return partner_points(found).groupBy("bp_key").agg(
        F.greatest(100 - F.sum("points"), F.lit(0)).cast("int").alias("score"))


def category_scores(found: DataFrame, relevance: DataFrame) -> DataFrame:
    """Per category, and for all (NULL): 100 less the points, weighted by money."""
    weight = weights(relevance)
    total = weight.agg(F.sum("weight").alias("total"))
    by_category = partner_points(found)
    every = by_category.groupBy("bp_key").agg(
        F.least(F.sum("points"), F.lit(100)).cast("int").alias("points")).select(
        "bp_key", F.lit(None).cast("string").alias("category"), "points")
    lost = by_category.unionByName(every).join(weight, "bp_key").groupBy("category").agg(
        F.sum(F.col("weight") * F.col("points")).alias("lost"), F.count("*").alias("partners"))
    # one row: the weight of all partners
    return lost.crossJoin(total).select("category", "partners", F.round(
        100 - F.col("lost").cast("double") / F.col("total").cast("double"), 4).alias("score"))
