"""Queries of what lasts from run to run, of kinds of impact, and of tables told by columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.operators import automation, explore
from ledgercheck.plans.bridge import raw_exports
from ledgercheck.plans.catalog import _digit, query
from ledgercheck.plans.derived import all_findings, model, settle_for
from ledgercheck.plans.run import documents_union
from ledgercheck.session import tune_tables, work_folder
from ledgercheck.sources.mapping import filled_columns, tell_tables

_COMPARED = ["tier", "impact", "current_value"]


def _flat(found: DataFrame) -> DataFrame:
    return found.select("finding_id", "rule_id", "damage_class", "tier",
                        F.col("impact_eur.amount").alias("impact"),
                        F.col("current.value").alias("current_value"))


def _decided(found: DataFrame, confirmed, day: str) -> DataFrame:
    return found.select("finding_id", "rule_id", confirmed.alias("confirmed"),
                        F.lit(day).cast("timestamp").alias("decided_at"))


def _record(spark, sf_dir) -> DataFrame:
    """Two rounds of review: the first confirms all but vendors' invoices of one digit, the second
    takes some confirmations of one rule back and confirms what the first did not."""
    found = all_findings(spark, sf_dir)
    state = automation.Versions(spark, work_folder(spark, "decided"), automation.DECIDED)
    first = ~((F.col("rule_id") == "AP-LEA-001") & (_digit() == "0"))
    state.upsert(_decided(found, first, "2026-01-02"), ["finding_id"], "decided_at")
    again = found.filter((F.col("rule_id") == "AP-COM-003") & (_digit() < "2"))
    state.upsert(_decided(again, F.lit(False), "2026-01-03").union(_decided(
        found.filter((F.col("rule_id") == "AP-LEA-001") & (_digit() == "0")), F.lit(True),
        "2026-01-03")), ["finding_id"], "decided_at")
    return automation.rule_record(state.read())


@query
def rule_automation(spark, sf_dir):
    return _record(spark, sf_dir)


@query
def earned_tiers(spark, sf_dir):
    found = _flat(all_findings(spark, sf_dir))
    return automation.with_earned_tiers(found, _record(spark, sf_dir)).select(
        "finding_id", "rule_id", "tier")


@query
def run_delta(spark, sf_dir):
    """The findings against an earlier run that lacked some, had others, and other tiers."""
    now = _flat(all_findings(spark, sf_dir))
    before = now.filter(_digit() != "0").withColumn("tier", F.when(
        _digit() == "1", F.lit("C")).otherwise(F.col("tier"))).withColumn("impact", F.when(
            _digit() != "2", F.col("impact")))
    return automation.delta(before, now.filter(_digit() != "f"), _COMPARED)


@query
def partner_scores(spark, sf_dir):
    return automation.partner_scores(all_findings(spark, sf_dir))


@query
def category_scores(spark, sf_dir):
    return automation.category_scores(all_findings(spark, sf_dir),
                                      model(spark, sf_dir)["bp_relevance"])


@query
def told_tables(spark, sf_dir):
    """The tables of the derived exports by the columns that have values; their names are not
    used.  Cleared items also fit the open ones, so they are ambiguous."""
    parts = [filled_columns(df.drop("_row_no"), f"file-{i:02d}") for i, (_, df) in enumerate(
        sorted(raw_exports(tune_tables(spark), sf_dir).items()))]
    return tell_tables(documents_union(parts))


@query
def totals_by_kind(spark, sf_dir):
    return explore.totals_by_kind(all_findings(spark, sf_dir))


@query
def top_by_kind(spark, sf_dir):
    return explore.top_by_kind(all_findings(spark, sf_dir)).select(
        "finding_id", "rule_id", "kind", "place")


@query
def placed_findings(spark, sf_dir):
    return explore.placed(all_findings(spark, sf_dir), settle_for(spark, "placed"))
