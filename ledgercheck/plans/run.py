"""A whole run: exports to findings, every stage written to the shared folder."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgercheck import PACK_VERSION, __version__
from ledgercheck.checks.contract import LazyModel, Model
from ledgercheck.checks.rules import RULES, Rule
from ledgercheck.functions import dates
from ledgercheck.operators import decisions, findings, relevance, report
from ledgercheck.operators.canonical import (
    ASKED,
    SOURCE,
    Canonical,
    Scope,
    Settle,
    build_canonical,
    conservation,
    delivered_window,
    emails,
    tiered_terms,
    unknown_vat_prefixes,
)
from ledgercheck.operators.staging import Staged, control_totals, stage, stage_counts
from ledgercheck.session import Stages, at_once, remove_folder, remove_folders, tune_tables, work_folder
from ledgercheck.sources import documents
from ledgercheck.sources.files import Export, read_exports
from ledgercheck.sources.mapping import EXPORT_TABLES


# Folders of settled tables: rows in question stand apart, checks of open items read these alone.
LAYOUT = {"fi_item-marked": ("is_open", SOURCE), "fi_item-asked": ("is_open", SOURCE)}


@dataclass(frozen=True)
class Settler:
    """Write an intermediate table and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the true size
    of what it joins.
    """

    spark: SparkSession
    folder: str

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        layout = [c for c in (ASKED, *LAYOUT.get(name, ())) if c in df.columns]
        df.write.mode("overwrite").partitionBy(*layout).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(df.columns)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; a name may end in '*'."""
        for name in names:
            remove_folders(self.spark, f"{self.folder}/{name}")


@dataclass
class Prepared:
    """Everything the checks read, and what was left out on the way."""

    staged: Mapping[str, Staged]
    canonical: Canonical
    model: Model
    scalars: Callable[[], tuple[str, dt.date]]
    dated_from: Callable[[], dt.date | None]

    @property
    def house_currency(self) -> str:
        return self.scalars()[0]

    @property
    def as_of(self) -> dt.date:
        return self.scalars()[1]

    @property
    def window_from(self) -> dt.date | None:
        return self.dated_from()

    def rejects(self) -> DataFrame:
        result = self.canonical.rejects()
        for part in self.staged.values():
            result = result.unionByName(part.rejects)
        return result


def prepare(
    raw: dict[str, DataFrame], settle: Settle, scope: Scope | None = None,
    data_as_of: dt.date | None = None, notation: str | None = None,
    thresholds: dict | None = None, lazy: bool = False,
    staged_all: Callable[[], None] = lambda: None,
) -> Prepared:
    """Stage the raw exports, build the canonical tables and the relevance of partners.

    With `lazy` every table is made when it is first asked for, with the exports behind it.
    Otherwise `staged_all` is called when no raw export is read any more."""
    scope = scope or Scope()

    def one(name: str) -> Staged:
        return stage(raw[name], name, settle, notation)

    # the large exports first, so that none of them is left for the end
    names = sorted((n for n in raw if n in EXPORT_TABLES),
                   key=lambda n: (EXPORT_TABLES[n].target != "fi_item", n))
    made = Stages(names, one)
    if not lazy:
        made.all()
        staged_all()
    staged = Stages(sorted(names), made.__getitem__)
    rows = Stages(sorted(names), lambda name: made[name].rows)
    canonical = build_canonical(rows, scope, settle, lazy)
    own = canonical.tables()

    @cache
    def scalars() -> tuple[str, dt.date]:
        # two scalars of the run: one value each, whatever the size of the data
        currency = relevance.house_currency(own["company_code"]).first()["currency"]
        return currency, relevance.data_as_of(own["fi_item"], data_as_of).first()["as_of"]

    @cache
    def window_from() -> dt.date | None:
        return scope.item_window_from or delivered_window(rows).first()["posting_date_from"]

    def table(name: str) -> DataFrame:
        if name != "bp_relevance":
            return own[name]
        currency, as_of = scalars()
        return settle(relevance.build_relevance(
            own["business_partner"], own["fi_item"], F.lit(as_of), F.lit(currency)), name)

    def aside(df: DataFrame, name: str) -> DataFrame:
        # a check may be asked for several times
        return settle(df, f"{name}-{uuid.uuid4().hex[:12]}")

    tables = Stages([*own, "bp_relevance"], table)
    if lazy:
        model = LazyModel(tables, lambda: (
            F.lit(scalars()[1]), F.lit(window_from()).cast("date")), thresholds or {}, aside)
    else:
        model = Model(tables.all(), F.lit(scalars()[1]), F.lit(window_from()).cast("date"),
                      thresholds or {}, aside)
    return Prepared(staged, canonical, model, scalars, window_from)


def run_id(
    exports: list[Export], scope: Scope, as_of: dt.date, notation: str | None,
    decisions_hash: str | None,
) -> str:
    """The date of the data, and a digest of all a result depends on but the versions."""
    facts = {
        "exports": {e.table: e.sha256 for e in exports},
        "scope": asdict(scope) | {"company_codes": sorted(set(scope.company_codes))},
        "notation": notation, "decisions": decisions_hash,
    }
    text = json.dumps(facts, sort_keys=True, default=str)
    return f"{as_of:%Y-%m-%d}-{hashlib.sha256(text.encode()).hexdigest()[:8]}"


def check_all(
    model: Model, ctx: findings.RunContext, settle: Settler, rules: list[Rule] = RULES,
) -> tuple[DataFrame, findings.Outcomes]:
    """Finding documents of all checks, enriched in one join for all rules, and what became of
    every rule."""
    folder = f"{settle.folder}/hits"

    def write(rule_id: str, hits: DataFrame) -> None:
        hits.drop("rule_id").write.mode("overwrite").parquet(f"{folder}/rule_id={rule_id}")

    outcomes = findings.run_rules(model, rules, write)
    none = findings.no_hits(model)
    found = none
    if outcomes.executed:
        found = settle.spark.read.schema(none.schema).option("basePath", folder).parquet(
            *[f"{folder}/rule_id={rule_id}" for rule_id in outcomes.executed])
    return findings.to_documents(findings.enriched(found, model), ctx, model.as_of), outcomes


@dataclass
class RunResult:
    """The tables of a finished run, read back from where they were written, and what became of
    its rules."""

    run_id: str
    folder: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    outcomes: findings.Outcomes = field(default_factory=findings.Outcomes)


def run_meta(
    spark: SparkSession, name: str, exports: list[Export], scope: Scope, prepared: Prepared,
    created_at: str,
) -> DataFrame:
    """The run described by itself, as one row."""
    files = [(e.name, e.table, e.sha256, e.encoding, e.delimiter) for e in exports]
    scope_row = (list(scope.company_codes), scope.side, scope.item_window_from,
                 scope.item_window_to, prepared.window_from)
    row = (name, __version__, PACK_VERSION, prepared.as_of, created_at, prepared.house_currency,
           files, scope_row)
    return spark.createDataFrame([row], (
        "run_id string, engine_version string, pack_version string, data_as_of date, "
        "created_at string, house_currency string, "
        "input_files array<struct<name:string,table:string,sha256:string,encoding:string,"
        "delimiter:string>>, "
        "scope struct<company_codes:array<string>,side:string,item_window_from:date,"
        "item_window_to:date,item_window_from_effective:date>"
    ))


def execute(
    spark: SparkSession, input_folder: str, out_folder: str, created_at: str,
    scope: Scope | None = None, data_as_of: dt.date | None = None, notation: str | None = None,
    memory: DataFrame | None = None, memory_hash: str | None = None,
    rules: list[Rule] = RULES, thresholds: dict | None = None,
) -> RunResult:
    """Run everything over a folder of exports and write the result tables.

    The time of the run is an argument, so that the same input gives the same output.  A run that
    breaks off leaves `aborted/run.json` with outcome 2 and the reason.
    """
    try:
        return _execute(spark, input_folder, out_folder, created_at, scope, data_as_of, notation,
                        memory, memory_hash, rules, thresholds)
    except Exception as error:
        reason = str(error).strip().splitlines()[0][:1000] if str(error).strip() else repr(error)
        spark.createDataFrame([(2, reason, created_at)], (
            "outcome int, reason string, created_at string")).write.mode("overwrite").json(
            f"{out_folder.rstrip('/')}/aborted/run.json")
        raise


def _execute(
    spark: SparkSession, input_folder: str, out_folder: str, created_at: str, scope: Scope | None,
    data_as_of: dt.date | None, notation: str | None, memory: DataFrame | None,
    memory_hash: str | None, rules: list[Rule], thresholds: dict | None,
) -> RunResult:
    tune_tables(spark)
    scope = scope or Scope()
    stamp = spark.range(1).select(dates.utc_stamp_text(F.lit(created_at)).alias("t")).first()["t"]
    if stamp is None:
        raise ValueError(f"created_at {created_at!r} is not a time in UTC")
    settle = Settler(spark, work_folder(spark, "run"))
    exports, raw = read_exports(spark, input_folder, settle)
    prepared = prepare(
        raw, settle, scope, data_as_of, notation, thresholds,
        staged_all=lambda: settle.drop("raw-*", "splits-*", "lines-*", "bits-*"))
    name = run_id(exports, scope, prepared.as_of, notation, memory_hash)
    ctx = findings.RunContext(name, stamp)
    told_of_staged = _of_staged(prepared, name, settle)
    settle.drop("staged-*", "*-marked/_asked=true")

    found, told = check_all(prepared.model, ctx, settle, rules)
    if memory is not None:
        as_text = memory.select(*[F.col(c).cast("string") for c in decisions.MEMORY_FIELDS])
        _refuse(decisions.memory_problems(as_text), "invalid decision entries", settle.folder)
        applied = decisions.apply_memory(found.drop("finding_key", "problem"), memory)
        keys = found.select("finding_id", "finding_key", "problem")
        found = applied.join(keys, "finding_id")
    found = settle(found, "findings")
    settle.drop("hits", "paid-invoices-*")
    _refuse(findings.violations(found), "invalid findings", settle.folder)
    _refuse(findings.collisions(found), "finding ids that occur twice", settle.folder)

    out = f"{out_folder.rstrip('/')}/{name}"
    outcomes = report.rule_outcomes(found, told)
    read_as_cp1252 = [(e.name, 1) for e in exports if e.encoding == "CP1252"]
    not_delivered = [(f"{name}.{column}", 1) for name, part in prepared.staged.items()
                     for column in part.missing]
    notes = report.hints({
        "read as CP1252": spark.createDataFrame(read_as_cp1252, "name string, n bigint"),
        "mapped column not delivered": spark.createDataFrame(
            not_delivered, "column string, n bigint"),
        **({"several e-mails": told_of_staged.pop("emails")} if "emails" in told_of_staged else {}),
        **({"decision without finding": decisions.orphans(found, memory).select(
            "finding_id", F.lit(1).alias("n"))} if memory is not None else {}),
        "unknown VAT prefix": unknown_vat_prefixes(prepared.model["bp_tax_id"]),
        "tiered payment terms": tiered_terms(prepared.model["payment_terms"]),
        "unclassified document type": relevance.unclassified_doc_types(
            prepared.model["business_partner"], prepared.model["fi_item"]
        ).select("doc_type", "n"),
    })
    tables = {
        **told_of_staged, "rule_outcomes": outcomes, "hints": notes,
        "run_meta": run_meta(spark, name, exports, scope, prepared, stamp),
        "finding_keys": found.select("finding_id", "finding_key"),
        **({"memory_summary": decisions.memory_summary(found, memory),
            "memory_orphans": decisions.orphans(found, memory)} if memory is not None else {}),
        **{f"canonical/{t}": df for t, df in prepared.model.tables.items()},
    }
    at_once(lambda t: tables[t].write.mode("overwrite").parquet(f"{out}/{t}"), tables)
    written = {t: spark.read.parquet(f"{out}/{t}") for t in tables}
    summary = report.run_totals(written["stage_counts"], written["canonical_counts"], found,
                                written["rule_outcomes"]).withColumn("run_id", F.lit(name))
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/run.json")
    found.select(*documents.finding_fields()).orderBy("finding_id").write.mode("overwrite").json(
        f"{out}/findings.json")
    if memory is not None:
        documents.write_memory(memory, f"{out}/decision_memory")
    written["findings"] = documents.read_findings(spark, f"{out}/findings.json")
    written["summary"] = spark.read.schema(summary.schema).json(f"{out}/run.json")
    _refuse(report.summary_problems(written["findings"], written["summary"]),
            "disagreements of summary and findings", settle.folder)
    remove_folder(spark, settle.folder)
    return RunResult(name, out, written, told)


def _of_staged(prepared: Prepared, name: str, settle: Settler) -> dict[str, DataFrame]:
    """What a run tells of its typed exports, written so that these need not be kept."""
    staged = prepared.staged
    told = {
        "rejects": report.with_run_id(prepared.rejects(), name),
        "stage_counts": documents_union([stage_counts(s) for s in staged.values()]),
        "canonical_counts": conservation(prepared.canonical),
        "control_totals": documents_union([
            control_totals(s).select(F.lit(s.table).alias("table"), "*")
            for s in staged.values() if "amount_signed_local" in s.rows.columns]),
    }
    if "ADR6" in staged:
        told["emails"] = emails(staged["ADR6"].rows).filter("ambiguous").agg(
            F.lit("addresses").alias("key"), F.count("*").alias("n"))
    return dict(zip(told, at_once(lambda t: settle(told[t], f"told-{t}"), told)))


def documents_union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _refuse(problems: DataFrame, what: str, folder: str) -> None:
    """Stop the run when there is any problem; all of them are written first."""
    path = f"{folder}/{what.replace(' ', '_')}"
    problems.write.mode("overwrite").parquet(path)
    n = problems.sparkSession.read.schema(problems.schema).parquet(path).count()
    if n:
        raise ValueError(f"{n} {what}, see {path}")
