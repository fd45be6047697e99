"""From check results to findings: enrichment, identity, and what makes one invalid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JNetworkError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgercheck import PACK_VERSION, __version__, fixed
from ledgercheck.checks.contract import Model, contract
from ledgercheck.checks.rules import RULES, Rule
from ledgercheck.functions import dates, ids, numbers, text
from ledgercheck.schema import CONTRACT, FINDING
from ledgercheck.session import at_once


@dataclass(frozen=True)
class RunContext:
    """What all findings of a run share; the time comes from outside, never from a clock."""

    run_id: str
    created_at: str
    engine_version: str = __version__
    pack_version: str = PACK_VERSION


@dataclass
class Outcomes:
    """What became of every rule: executed, skipped for missing tables, or failed and why."""

    executed: list[str] = field(default_factory=list)
    skipped: dict[str, list[str]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def refuse_gaps(self) -> None:
        """Stop when a rule was skipped or failed: for readers of findings who do not see that."""
        gaps = [f"{rule} skipped, missing tables: {', '.join(tables)}"
                for rule, tables in self.skipped.items()]
        gaps += [f"{rule} failed: {reason}" for rule, reason in self.failed.items()]
        if gaps:
            raise ValueError("not all checks were executed: " + "; ".join(gaps))


# marks of errors that say nothing about a check or its data
_INFRASTRUCTURE = (
    "ExecutorLostFailure", "FetchFailed", "java.io.IOException", "java.net.", "OutOfMemoryError",
    "No space left on device", "SparkContext was shut down", "stopped SparkContext",
    "MetadataFetchFailed", "TimeoutException", "Could not execute broadcast", "Cannot broadcast",
    "maxResultSize", "was cancelled", "Python worker exited unexpectedly",
)


def of_infrastructure(error: Exception) -> bool:
    """Lost executors, broken storage or a stopped session, as against a check that fails."""
    return isinstance(error, (OSError, MemoryError, Py4JNetworkError)) or any(
        mark in str(error) for mark in _INFRASTRUCTURE)


def run_rules(
    model: Model, rules: list[Rule], write: Callable[[str, DataFrame], None]
) -> Outcomes:
    """Run every rule whose tables are there and `write` its hits.

    A check that fails, be it while it is planned or while it runs, is an outcome of that rule;
    the others go on.  The outcomes belong to the result: a caller hands them on or refuses gaps.
    Errors of the infrastructure end the run: the check was not tried.
    """
    def one(rule: Rule) -> tuple[str, str, object]:
        absent = model.missing(rule.requires)
        if absent:
            return rule.id, "skipped", absent
        try:
            write(rule.id, with_rule(rule.check(model), rule))
        except Exception as error:  # the reason goes into the report
            if of_infrastructure(error):
                raise
            return rule.id, "failed", (str(error).strip() or repr(error)).splitlines()[0][:300]
        return rule.id, "executed", None

    found = Outcomes()
    for rule_id, status, detail in at_once(one, rules):
        if status == "executed":
            found.executed.append(rule_id)
        else:
            getattr(found, status)[rule_id] = detail
    return found


def no_hits(model: Model) -> DataFrame:
    """Hits of no rule: the columns `with_rule` gives."""
    none = contract(model["business_partner"].filter(F.lit(False)), bp_key=F.col("bp_key"))
    return with_rule(none, RULES[0])


def check_contract(columns: list[str]) -> None:
    """Stop on a missing, unknown or repeated contract column."""
    required = {"bp_key", "role", "source_table", "source_field", "current_value"}
    missing, unknown = sorted(required - set(columns)), sorted(set(columns) - set(CONTRACT))
    repeated = sorted({c for c in columns if columns.count(c) > 1})
    if missing or unknown or repeated:
        raise ValueError(f"contract: missing {missing}, unknown {unknown}, repeated {repeated}")


def with_rule(results: DataFrame, rule: Rule) -> DataFrame:
    """Check results with what their rule adds: texts, classes, and the finding id."""
    check_contract(results.columns)
    remediation = rule.remediation
    return results.select(
        ids.finding_id(F.lit(rule.id)).alias("finding_id"),
        F.lit(rule.id).alias("rule_id"), F.lit(rule.version).alias("rule_version"),
        F.lit(rule.side).alias("side"), F.lit(rule.category).alias("category"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.damage_class).alias("damage_class"),
        F.coalesce("tier", F.lit(rule.tier)).alias("tier"),
        F.coalesce("action_type", F.lit(rule.action_type)).alias("action_type"),
        text.fill(rule.title, F.col("params")).alias("title"),
        text.fill(rule.why, F.col("params")).alias("why"),
        text.fill(rule.if_wrong, F.col("params")).alias("if_wrong"),
        F.struct(
            F.lit(remediation.sap_transaction).alias("sap_transaction"),
            F.lit(remediation.path).alias("path"),
            F.lit(remediation.field).cast("string").alias("field"),
            F.lit(remediation.mass_change_eligible).alias("mass_change_eligible"),
            F.array(*[F.lit(s) for s in remediation.steps]).cast("array<string>").alias("steps"),
        ).alias("remediation"),
        *[c for c in CONTRACT if c not in ("tier", "action_type", "params")],
    )


def enriched(found: DataFrame, model: Model) -> DataFrame:
    """Findings with the partner's name and relevance, joined once for all rules."""
    names = model["business_partner"].select(
        "bp_key", text.display_name(F.col("name1"), F.col("city")).alias("display_name")
    )
    df = found.join(names, "bp_key", "left")
    if "bp_relevance" not in model.tables:
        return df.withColumn("relevance", F.lit(None).cast(
            "struct<open_items:string,volume_12m:string,currency:string,last_activity_on:string>"))
    relevance = model["bp_relevance"].select("bp_key", F.struct(
        numbers.amount_text(F.col("open_items_local")).alias("open_items"),
        numbers.amount_text(F.col("volume_12m_local")).alias("volume_12m"),
        "currency", dates.iso_text(F.col("last_activity_on")).alias("last_activity_on"),
    ).alias("relevance"))
    return df.join(relevance, "bp_key", "left")


def _filled(array: str) -> Column:
    return F.when(F.size(array) > 0, F.col(array))


def to_documents(found: DataFrame, ctx: RunContext, as_of: Column) -> DataFrame:
    """The finding document; `finding_key` and `problem` stay beside it for the checks."""
    target = {f.name: f.dataType for f in T._parse_datatype_string(FINDING).fields}
    has_target = F.coalesce(
        F.col("proposed_value"), F.col("proposed_display"),
        F.when(F.size("options") > 0, F.lit("options")),
    ).isNotNull()
    columns = {
        "run_id": F.lit(ctx.run_id), "engine_version": F.lit(ctx.engine_version),
        "pack_version": F.lit(ctx.pack_version),
        "entity": F.struct(
            "bp_key", "role", "company_code", "display_name",
            _filled("related_bp_keys").alias("related_bp_keys"),
            _filled("documents").alias("documents"), _filled("records").alias("records")),
        "current": F.struct(
            "source_table", "source_field", F.col("current_value").alias("value"),
            F.col("current_display").alias("display")),
        "proposed": F.when(has_target, F.struct(
            F.col("proposed_value").alias("value"), F.col("proposed_display").alias("display"),
            "source_summary", _filled("options").alias("options"),
            F.lit(None).cast(target["proposed"]["golden_record"].dataType).alias("golden_record"))),
        "impact_eur": F.when(F.col("impact_amount").isNotNull(), F.struct(
            numbers.amount_text(F.col("impact_amount")).alias("amount"),
            F.col("impact_currency").alias("currency"), F.col("impact_formula").alias("formula"),
            "netted_against")),
        "related_finding_ids": F.lit(None), "status": F.lit("open"), "decision": F.lit(None),
        "data_as_of": dates.iso_text(as_of), "created_at": F.lit(ctx.created_at),
    }
    summary_only = ~has_target & F.col("source_summary").isNotNull()
    return found.select(
        *[columns.get(name, F.col(name)).cast(kind).alias(name) for name, kind in target.items()],
        "finding_key",
        F.when(summary_only, F.lit("proposed: only a summary")).alias("problem"),
    )


def finding_columns() -> list[str]:
    return [f.name for f in T._parse_datatype_string(FINDING).fields]


# -- what makes a finding invalid --------------------------------------------------------

_REQUIRED = (
    "finding_id", "run_id", "rule_id", "rule_version", "engine_version", "pack_version", "side",
    "category", "severity", "damage_class", "tier", "action_type", "title", "entity.bp_key",
    "entity.role", "current.source_table", "current.source_field", "why", "if_wrong",
    "remediation.sap_transaction", "remediation.mass_change_eligible", "status", "data_as_of",
    "created_at",
)
_ENUMS = {
    "side": fixed.SIDES, "category": fixed.CATEGORIES, "severity": fixed.SEVERITIES,
    "damage_class": (1, 2, 3), "tier": fixed.TIERS, "action_type": fixed.ACTION_TYPES,
    "status": fixed.STATUSES, "entity.role": ("CUSTOMER", "VENDOR"),
}


def _all_match(array: str, field: str, pattern: str) -> Column:
    return F.forall(array, lambda x: x.getField(field).isNull() | x.getField(field).rlike(pattern))


def _constraints() -> list[tuple[str, Column]]:
    """(name, condition that must not be false) for every rule a finding has to keep."""
    c = F.col
    found = [(f"required: {name}", c(name).isNotNull()) for name in _REQUIRED]
    found += [(f"form: {name}", c(name).rlike(form)) for name, form in fixed.FINDING_FORMS.items()]
    found += [(f"enum: {name}", c(name).isin(*values)) for name, values in _ENUMS.items()]
    found += [
        ("length: title", F.length("title").between(1, 120)),
        ("length: why", F.length("why") >= 10),
        ("length: if_wrong", F.length("if_wrong") >= 5),
        ("length: run_id", F.length("run_id") >= 1),
        ("form: created_at", F.try_to_timestamp(c("created_at")).isNotNull()),
        ("required: relevance.currency", c("relevance").isNull()
         | c("relevance.currency").isNotNull()),
        ("required: impact_eur", c("impact_eur").isNull() | (
            c("impact_eur.amount").isNotNull() & c("impact_eur.currency").isNotNull()
            & c("impact_eur.formula").isNotNull())),
        ("required: proposed.source_summary", c("proposed").isNull()
         | c("proposed.source_summary").isNotNull()),
        ("required: decision", c("decision").isNull() | (
            c("decision.by").isNotNull() & c("decision.at").isNotNull()
            & c("decision.reason").isNotNull())),
        ("required: evidence", F.forall("evidence", lambda e: e["reference"].isNotNull()
                                        & e["agrees"].isNotNull())),
        ("enum: evidence.source_type", F.forall(
            "evidence", lambda e: e["source_type"].isin(*fixed.EVIDENCE_SOURCES))),
        ("enum: evidence.reference_kind", F.forall(
            "evidence", lambda e: e["reference_kind"].isNull()
            | e["reference_kind"].isin(*fixed.REFERENCE_KINDS))),
        ("form: evidence.observed_at", _all_match("evidence", "observed_at", fixed.DATE_PATTERN)),
        ("required: documents", F.forall("entity.documents", lambda d: (
            d["company_code"].isNotNull() & d["fiscal_year"].isNotNull()
            & d["document_no"].isNotNull()))),
        ("form: documents.amount", _all_match("entity.documents", "amount", fixed.AMOUNT_PATTERN)),
        ("form: documents.currency", _all_match("entity.documents", "currency", fixed.CURRENCY_PATTERN)),
        ("form: documents.document_date", _all_match("entity.documents", "document_date", fixed.DATE_PATTERN)),
        ("form: documents.cleared_on", _all_match("entity.documents", "cleared_on", fixed.DATE_PATTERN)),
        ("form: records.bp_key", _all_match("entity.records", "bp_key", fixed.KEY_PATTERN)),
        ("form: records.iban_masked", F.forall("entity.records", lambda r: (
            r["fields"]["iban_masked"].isNull() | r["fields"]["iban_masked"].rlike(fixed.MASK_PATTERN)))),
        ("form: records.country", F.forall("entity.records", lambda r: (
            r["fields"]["country"].isNull() | r["fields"]["country"].rlike(r"^[A-Z]{2}\z")))),
        ("form: records.open_items", F.forall("entity.records", lambda r: (
            r["fields"]["open_items"].isNull() | r["fields"]["open_items"].rlike(fixed.AMOUNT_PATTERN)))),
        ("required: options", F.forall("proposed.options", lambda o: (
            o["label"].isNotNull() & o["consequence"].isNotNull()))),
        # three rules across fields
        ("bank data is never tier A", ~((c("damage_class") == 1) & (c("tier") == "A"))),
        ("tier A and B need a proposal", ~(c("tier").isin("A", "B") & c("proposed").isNull())),
        ("mass_change only with tier A",
         ~((c("action_type") == "mass_change") & (c("tier") != "A"))),
    ]
    return found


def violations(findings: DataFrame) -> DataFrame:
    """One row per finding and rule it breaks.

    A condition over an absent optional part is unknown and counts as kept.
    """
    broken = [
        F.when(~F.coalesce(condition, F.lit(True)), F.lit(name))
        for name, condition in _constraints()
    ]
    if "problem" in findings.columns:
        broken.append(F.col("problem"))
    return findings.select(
        "finding_id", "rule_id", F.explode(F.array_compact(F.array(*broken))).alias("violation")
    )


def collisions(findings: DataFrame) -> DataFrame:
    """Finding ids that occur twice, within one rule or from two rules."""
    return findings.groupBy("finding_id").agg(
        F.count("*").alias("n"), F.min("rule_id").alias("first_rule"),
        F.max("rule_id").alias("last_rule"),
    ).filter("n > 1")


def duplicate_ids_across_files(findings: DataFrame, file: str = "file") -> DataFrame:
    """Finding ids found in several files, with the files."""
    return findings.groupBy("finding_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set(file)).alias("files")
    ).filter("n > 1")
