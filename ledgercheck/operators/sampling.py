"""Samples per rule, what reviewers decided on them, and what follows for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgercheck import fixed
from ledgercheck.functions.text import said
from ledgercheck.operators.explore import is_open, is_releasable

SAMPLE_SIZE = 10


def candidates(findings: DataFrame) -> DataFrame:
    return findings.filter(is_open() & is_releasable())


def draw_sample(findings: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """At most `size` findings per rule, the same for every order of the input.

    The order is a hash over run, rule and finding.  Spark keeps only the first `size`
    rows per rule in each partition before the shuffle, so a rule with most of the
    findings costs no more than another.
    """
    order = F.sha2(F.concat_ws("|", "run_id", "rule_id", "finding_id"), 256)
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy("order", "finding_id"))
    return (
        candidates(findings).select("rule_id", "finding_id", order.alias("order"))
        .withColumn("place", place).filter(F.col("place") <= size)
        .select("rule_id", "finding_id", "place")
    )


def sample_progress(sample: DataFrame, records: DataFrame) -> DataFrame:
    """Per rule: size, decided, accepted, assigned, the first rejected finding, next step."""
    action = F.col("action")
    progress = sample.join(records.select("finding_id", "action"), "finding_id", "left").groupBy(
        "rule_id"
    ).agg(
        F.count("*").alias("size"), F.count("action").alias("decided"),
        F.count(F.when(action == "accept", 1)).alias("accepted"),
        F.count(F.when(action == "assign", 1)).alias("assigned"),
        F.min(F.when(action == "reject", F.struct("place", "finding_id"))).alias("rejected"),
    ).withColumn("rejected_id", F.col("rejected.finding_id")).drop("rejected")
    return progress.withColumn("step", next_step())


def next_step() -> Column:
    return (
        F.when(F.col("rejected_id").isNotNull(), F.lit("blocked"))
        .when(F.col("decided") < F.col("size"), F.lit("continue"))
        .when(F.col("accepted") == F.col("size"), F.lit("release"))
        .otherwise(F.lit("incomplete"))
    )


def group_release(
    findings: DataFrame, progress: DataFrame, records: DataFrame, by: str, at: str
) -> DataFrame:
    """Accept records for the rest of every rule whose whole sample was accepted."""
    released = progress.filter("step = 'release'").select("rule_id", "size")
    totals = findings.groupBy("rule_id").agg(F.count("*").alias("total"))
    rules = released.join(totals, "rule_id")
    reason = said(fixed.GROUP_RELEASED, size=F.col("size"), total=F.col("total"))
    absent = F.lit(None).cast("string")
    return (
        candidates(findings).select("finding_id", "rule_id").join(rules, "rule_id")
        .join(records.select("finding_id"), "finding_id", "left_anti")
        .select("finding_id", F.lit("accept").alias("action"), absent.alias("reason_code"),
                reason.alias("reason"), absent.alias("assigned_to"),
                F.lit(by.strip()).alias("by"), F.lit(at).alias("at"))
    )


def group_reviews(progress: DataFrame, by: str, at: str) -> DataFrame:
    """What is recorded per rule: released, or blocked by its first rejected finding."""
    outcome = F.when(F.col("step") == "release", F.lit("released")).when(
        F.col("step") == "blocked", F.lit("blocked")
    )
    return progress.withColumn("outcome", outcome).filter("outcome IS NOT NULL").select(
        "rule_id", "outcome", F.col("rejected_id").alias("blocked_by_finding_id"),
        F.lit(by.strip()).alias("by"), F.lit(at).alias("at"),
    )


def review_ids(
    reviews: DataFrame, sample: DataFrame, released: DataFrame, findings: DataFrame
) -> DataFrame:
    """The findings of every review, one row each: those sampled, and those the release applies
    to.  A rule may have any number of the latter, so they are no list."""
    rules = findings.select("finding_id", "rule_id")
    sampled = reviews.select("rule_id").join(sample, "rule_id").select(
        "rule_id", F.lit("sampled").alias("part"), "finding_id")
    applied = released.select("finding_id").join(rules, "finding_id").join(
        reviews.filter("outcome = 'released'").select("rule_id"), "rule_id").select(
        "rule_id", F.lit("applied").alias("part"), "finding_id")
    return sampled.unionByName(applied)
