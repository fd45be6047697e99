"""Decisions of reviewers: checked, applied to findings, kept from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.fixed import DECISION_ACTIONS, REASON_LABELS, REASON_STATUS
from ledgercheck.functions.dates import utc_minute_text

MEMORY_FIELDS = (
    "finding_id", "rule_id", "bp_key", "decided_by", "decided_at", "reason_code", "reason",
)
RECORD_FIELDS = (
    "finding_id", "action", "reason_code", "reason", "assigned_to", "by", "at",
)


def _mapped(column: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


# -- the decision memory of the engine ----------------------------------------------------

def memory_problems(memory: DataFrame) -> DataFrame:
    """One row per entry and rule it breaks; `decided_at` is still text."""
    stamped = F.try_to_timestamp(F.col("decided_at")).isNotNull()
    checks = [F.when(_blank(f), F.lit(f"missing: {f}")) for f in MEMORY_FIELDS]
    checks += [
        F.when(~F.col("reason_code").isin(*REASON_STATUS), F.lit("unknown reason_code")),
        F.when(~_blank("decided_at") & ~stamped, F.lit("decided_at is no time")),
    ]
    single = memory.select(
        "finding_id", F.explode(F.array_compact(F.array(*checks))).alias("problem")
    )
    twice = memory.groupBy("finding_id").count().filter("count > 1").select(
        "finding_id", F.lit("finding_id twice").alias("problem")
    )
    return single.unionByName(twice)


def typed_memory(memory: DataFrame) -> DataFrame:
    return memory.select(*[
        F.try_to_timestamp(F.col(f)).alias(f) if f == "decided_at" else F.col(f)
        for f in MEMORY_FIELDS
    ])


def memory_mismatches(findings: DataFrame, memory: DataFrame) -> DataFrame:
    """Entries whose rule or partner is not the one of the finding they name."""
    found = findings.select(
        "finding_id", F.col("rule_id").alias("found_rule"),
        F.col("entity.bp_key").alias("found_bp_key"),
    )
    return memory.join(found, "finding_id").filter(
        (F.col("rule_id") != F.col("found_rule")) | (F.col("bp_key") != F.col("found_bp_key"))
    ).select("finding_id", "rule_id", "bp_key", "found_rule", "found_bp_key")


def apply_memory(findings: DataFrame, memory: DataFrame) -> DataFrame:
    """Findings with the status their memory entry asks for; a mismatch fails the job."""
    entries = memory.select(
        "finding_id", F.struct(*[c for c in MEMORY_FIELDS if c != "finding_id"]).alias("_entry")
    )
    joined = findings.join(entries, "finding_id", "left")
    entry = F.col("_entry")
    foreign = (entry["rule_id"] != F.col("rule_id")) | (entry["bp_key"] != F.col("entity.bp_key"))
    status = (
        F.when(foreign, F.raise_error(F.concat(
            F.lit("the decision does not belong to finding "), "finding_id")).cast("string"))
        .when(entry.isNotNull(), _mapped(entry["reason_code"], REASON_STATUS))
        .otherwise(F.col("status"))
    )
    decision = F.when(entry.isNotNull(), F.struct(
        entry["decided_by"].alias("by"),
        F.date_format(entry["decided_at"], "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        entry["reason"].alias("reason"), entry["reason_code"].alias("reason_code"),
        F.lit(None).cast("string").alias("assigned_to"),
    )).otherwise(F.col("decision"))
    return joined.withColumns({"status": status, "decision": decision}).select(findings.columns)


def orphans(findings: DataFrame, memory: DataFrame) -> DataFrame:
    """Entries no finding of the run matches."""
    return memory.select("finding_id", "rule_id", "bp_key").join(
        findings.select("finding_id"), "finding_id", "left_anti"
    )


def memory_summary(findings: DataFrame, memory: DataFrame) -> DataFrame:
    """Loaded, applied and orphaned entries, as one row."""
    known = memory.join(
        findings.select("finding_id", F.lit(True).alias("known")), "finding_id", "left"
    )
    return known.agg(
        F.count("*").alias("loaded"), F.count("known").alias("applied"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("orphans"),
    )


# -- the decision records of the explorer ---------------------------------------------------

def record_status() -> Column:
    """The status a record gives its finding."""
    rejected = F.when(F.col("reason_code") == "accepted_risk", F.lit("accepted_risk"))
    return F.when(F.col("action") == "reject", rejected.otherwise(F.lit("rejected"))).otherwise(
        F.lit("in_progress")
    )


def create_records(choices: DataFrame) -> DataFrame:
    """Records from choices (finding_id, action, reason_code, reason, assigned_to,
    chosen_option, by, at); a reason nobody typed follows from the action."""
    assignee = F.when(~_blank("assigned_to"), F.trim("assigned_to"))
    derived = (
        F.when(F.col("action") == "accept", F.coalesce(
            F.concat(F.lit("Option gewählt: "), "chosen_option"), F.lit("Vorschlag übernommen")))
        .when(F.col("action") == "assign", F.concat(
            F.lit("Zugewiesen an "), F.coalesce(assignee, F.lit("unbekannt"))))
        .otherwise(F.coalesce(_mapped(F.col("reason_code"), REASON_LABELS), F.lit("Abgelehnt")))
    )
    return choices.select(
        "finding_id", "action", "reason_code",
        F.when(_blank("reason"), derived).otherwise(F.trim("reason")).alias("reason"),
        F.when(F.col("action") == "assign", F.trim("assigned_to")).alias("assigned_to"),
        F.trim("by").alias("by"), "at",
    )


def latest_records(log: DataFrame, sequence: str = "at") -> DataFrame:
    """The last record per finding of a log; a last action 'clear' leaves none.

    One maximum per finding, taken on the map side first, instead of a window.
    """
    rest = [c for c in log.columns if c not in ("finding_id", sequence)]
    last = log.groupBy("finding_id").agg(F.max(F.struct(sequence, *rest)).alias("last"))
    return last.filter("last.action <> 'clear'").select(
        "finding_id", *[F.col(f"last.{c}").alias(c) for c in [sequence, *rest]]
    ).select(*log.columns)


def overlay(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings with status and decision of their record, where there is one."""
    decided = records.select(
        "finding_id", record_status().alias("_status"),
        F.struct("by", "at", "reason", "reason_code", F.lit(None).cast("string")
                 .alias("assigned_to")).alias("_decision"),
    )
    return findings.join(decided, "finding_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "decision": F.coalesce("_decision", "decision"),
    }).select(findings.columns)


def record_problems(records: DataFrame) -> DataFrame:
    """One row per record and rule it breaks; any of them refuses the whole file."""
    checks = [F.when(_blank(f), F.lit(f"missing: {f}"))
              for f in ("finding_id", "action", "at", "reason", "by")]
    checks += [
        F.when(~F.col("action").isin(*DECISION_ACTIONS), F.lit("unknown action")),
        F.when(~F.col("reason_code").isin(*REASON_STATUS), F.lit("unknown reason_code")),
        F.when(~_blank("at") & utc_minute_text(F.col("at")).isNull(), F.lit("at is not UTC")),
    ]
    single = records.select(
        "finding_id", F.explode(F.array_compact(F.array(*checks))).alias("problem")
    )
    twice = records.groupBy("finding_id").count().filter("count > 1").select(
        "finding_id", F.lit("finding_id twice").alias("problem")
    )
    return single.unionByName(twice)


def import_records(records: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of findings that are loaded, and the ids of those that are not."""
    known = findings.select("finding_id")
    return (records.join(known, "finding_id", "left_semi"),
            records.select("finding_id").join(known, "finding_id", "left_anti"))


def import_report(
    records: DataFrame, findings: DataFrame, file_run_id: str, samples: DataFrame | None = None
) -> DataFrame:
    """One row: how many records and sample reviews apply, and whether the run is the same."""
    marked = records.join(
        findings.select("finding_id", F.lit(True).alias("known")), "finding_id", "left"
    ).agg(F.count("*").alias("total"), F.count("known").alias("applied"),
          F.count(F.when(F.col("known").isNull(), 1)).alias("missing"))
    run = findings.agg(F.min("run_id").alias("loaded_run")).scalar()
    report = marked.withColumns({
        "file_run": F.lit(file_run_id), "loaded_run": run,
        "run_mismatch": ~run.eqNullSafe(F.lit(file_run_id)),
    })
    if samples is None:
        return report
    rules = findings.select("rule_id", F.lit(True).alias("known")).distinct()
    reviewed = samples.join(rules, "rule_id", "left").agg(
        F.struct(F.count("*").alias("total"), F.count("known").alias("applied")).alias("s")
    ).scalar()
    return report.withColumns({"samples_total": reviewed["total"],
                               "samples_applied": reviewed["applied"]})


def cleanup_list(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Accepted mass changes, as the rows of the clean-up list plus their sort key."""
    accepted = records.filter("action = 'accept'").select("finding_id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return findings.filter("action_type = 'mass_change'").join(
        accepted, "finding_id", "left_semi"
    ).select(
        F.col("entity.bp_key").alias("bp_key"), text("entity.company_code").alias("company_code"),
        F.col("current.source_table").alias("source_table"),
        F.col("current.source_field").alias("source_field"),
        text("current.value").alias("current"), text("proposed.value").alias("proposed"),
        "tier", "rule_id", "finding_id",
    )
