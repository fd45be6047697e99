"""Every registered query: (spark, data folder) to a flat DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgercheck.checks import bank_data, cross_role, double_payment, items, master_data
from ledgercheck.checks.contract import Model
from ledgercheck.checks.rules import RULE_BY_ID, RULES
from ledgercheck.fixed import SEVERITIES, STATUSES, TIERS, VAT_PATTERNS
from ledgercheck.functions import bank, dates, numbers, text
from ledgercheck.operators import (
    canonical,
    compare,
    decisions,
    explore,
    findings,
    relevance,
    report,
    sampling,
    staging,
)
from ledgercheck.operators.findings import Outcomes
from ledgercheck.plans import run
from ledgercheck.plans.bridge import raw_exports
from ledgercheck.plans.derived import (
    CONTEXT,
    _once,
    all_findings,
    export_folder,
    flawed_exports,
    model,
    prepared,
    settle_for,
)
from ledgercheck.session import tune_tables, work_folder
from ledgercheck.sources import documents, files
from ledgercheck.sources.mapping import check_header

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune_tables(spark).read.parquet(f"{sf_dir}/{table}.parquet")


# -- text to value --------------------------------------------------------------------------

def _price_text(df: DataFrame) -> DataFrame:
    """Prices written in eight ways, by order number."""
    return df.selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_extendedprice AS DECIMAL(15,2)) AS price"
    ).selectExpr("l_orderkey", "l_linenumber", """
        CASE l_orderkey % 8
            WHEN 0 THEN translate(format_number(price, 2), ',.', '.,')
            WHEN 1 THEN CAST(price AS STRING)
            WHEN 2 THEN concat(translate(format_number(price, 2), ',.', '.,'), '-')
            WHEN 3 THEN concat('+', CAST(price AS STRING))
            WHEN 4 THEN format_number(price, 2)
            WHEN 5 THEN translate(format_number(price, 2), ',.', ' ,')
            WHEN 6 THEN translate(format_number(floor(price), 0), ',', '.')
            ELSE 'n/a' END AS text""")


@query
def parse_amount(spark, sf_dir):
    df = _price_text(_read(spark, sf_dir, "lineitem"))
    for notation in ("de", "iso", None):
        df = staging.parse_values(df, "text", "amount", notation).withColumnRenamed(
            "text__typed", f"value_{notation or 'none'}")
    return df


@query
def parse_array(spark, sf_dir):
    """The prices of an order as one array parameter."""
    texts = _price_text(_read(spark, sf_dir, "lineitem")).groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "text"))),
                    lambda x: x["text"]).alias("texts"))
    return staging.parse_array(texts, ["l_orderkey"], "texts", "amount", "de")


@query
def parse_percent(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_discount * 100 AS DECIMAL(5,3)) AS rate"
    ).selectExpr("l_orderkey", "l_linenumber", """
        CASE l_orderkey % 4 WHEN 0 THEN translate(CAST(rate AS STRING), '.', ',')
            WHEN 1 THEN CAST(rate AS STRING) WHEN 2 THEN concat('1.', CAST(rate AS STRING), ',0')
            ELSE CAST(CAST(rate AS INT) AS STRING) END AS text""")
    return staging.parse_values(df, "text", "percent").withColumnRenamed("text__typed", "value")


@query
def parse_date(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", """
        CASE l_orderkey % 6 WHEN 0 THEN date_format(l_shipdate, 'yyyyMMdd')
            WHEN 1 THEN date_format(l_shipdate, 'dd.MM.yyyy')
            WHEN 2 THEN date_format(l_shipdate, 'd.M.yyyy')
            WHEN 3 THEN date_format(l_shipdate, ' yyyy-MM-dd ')
            WHEN 4 THEN concat('31.02.', year(l_shipdate)) ELSE '00000000' END AS text""")
    return df.withColumn("value", dates.parse_date(F.col("text")))


@query
def parse_integer(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", """
        CASE l_orderkey % 5 WHEN 0 THEN lpad(CAST(l_partkey AS STRING), 9, '0')
            WHEN 1 THEN concat(l_partkey, '-') WHEN 2 THEN concat(l_partkey, ',0')
            WHEN 3 THEN concat('99', lpad(CAST(l_partkey AS STRING), 9, '0'))
            ELSE concat('+', l_partkey) END AS text""")
    return df.withColumn("value", numbers.parse_integer(F.col("text")))


@query
def parse_flag(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", """
        CASE l_returnflag WHEN 'R' THEN 'X' WHEN 'A' THEN ' x ' ELSE '' END AS text""")
    return df.withColumn("value", text.parse_flag(F.col("text")))


@query
def value_notation(spark, sf_dir):
    df = _price_text(_read(spark, sf_dir, "lineitem"))
    return df.groupBy((F.col("l_orderkey") % 8).cast("int").alias("form"),
                      numbers.value_notation(F.col("text")).alias("notation")).agg(
        F.count("*").alias("n"))


@query
def file_notation(spark, sf_dir):
    raw = raw_exports(tune_tables(spark), sf_dir)
    parts = [staging.file_notation(raw[t], t).select(F.lit(t).alias("table"), "*")
             for t in ("BSAD", "BSAK", "BSID", "BSIK")]
    return run.documents_union(parts)


@query
def money_text(spark, sf_dir):
    amount = F.col("o_totalprice").cast("decimal(15,2)")
    signed = F.when(F.col("o_orderstatus") == "F", -amount).otherwise(amount)
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.money(signed, F.lit("EUR")).alias("money"),
        numbers.group_digits(F.floor("o_totalprice").cast("string")).alias("digits"),
        dates.date_text(F.to_date("o_orderdate")).alias("day"),
        numbers.trim_zeros((F.col("o_orderkey") % 100 / 20).cast("decimal(5,3)")).alias("rate"),
        numbers.parse_cents(numbers.amount_text(amount)).cast("bigint").alias("cents"),
    )


@query
def text_norms(spark, sf_dir):
    name = F.col("c_name")
    key = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    return _read(spark, sf_dir, "customer").select(
        "c_custkey", text.reference_norm(F.concat(name, F.lit("/ä-"), F.col("c_custkey")))
        .alias("reference_norm"),
        text.tax_norm(F.concat(F.lit("de 12."), F.col("c_custkey"))).alias("tax_norm"),
        text.iban_norm(F.concat(F.lit("de12 34 "), F.col("c_custkey"))).alias("iban_norm"),
        text.name_core(F.concat(F.lit("Müßige Ñandú & "), name)).alias("name_core"),
        text.plain_account(F.concat(F.lit("C:"), key)).alias("account"),
        text.display_name(name, F.when(F.col("c_custkey") % 2 == 0, F.lit(" "))
                          .otherwise(F.col("c_mktsegment"))).alias("display_name"),
        text.partner_key(F.when(F.col("c_custkey") % 7 != 0, key), "C:").alias("bp_key"),
    )


@query
def utc_text(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.concat(iso, F.when(F.col("event_id") % 3 == 0, F.lit("Z"))
                     .when(F.col("event_id") % 3 == 1, F.lit("+00:00")).otherwise(F.lit("+02:00")))
    return _read(spark, sf_dir, "events").select(
        "event_id", dates.utc_stamp_text(stamp).alias("stamp"),
        dates.utc_minute_text(stamp).alias("minute"))


@query
def window_starts(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(
    ).select("day", dates.months_back(F.col("day"), 12).alias("year_before"),
             F.date_add("day", 180).alias("later"))


# -- exports as files -------------------------------------------------------------------------

@query
def file_listing(spark, sf_dir):
    listed = files.list_files(spark, export_folder(spark, sf_dir))
    return listed.select("name", "table").distinct()


@query
def file_collisions(spark, sf_dir):
    """Tables that several exports claim, in a folder where nations share names."""
    return files.name_collisions(files.list_files(spark, flawed_exports(spark, sf_dir))).select(
        "table", F.array_join("names", ",").alias("names"))


@query
def file_probe(spark, sf_dir):
    """Encoding, delimiter and lines of data of every export."""
    return files.judge_exports(files.probe(spark, export_folder(spark, sf_dir))).select(
        "table", "encoding", "delimiter", "parts_differ", "data_lines")


@query
def file_header_problems(spark, sf_dir):
    """What is wrong with the headers of the same folder."""
    return files.header_problems(files.probe(spark, flawed_exports(spark, sf_dir)))


@query
def file_hashes(spark, sf_dir):
    exports, _ = files.read_exports(spark, export_folder(spark, sf_dir), settle_for(spark, "hash"))
    return spark.createDataFrame([(e.table, e.name, e.sha256) for e in exports],
                                 "table string, name string, sha256 string")


@query
def raw_rows(spark, sf_dir):
    """Text rows and line numbers of exports in UTF-8, UTF-16 and CP1252."""
    _, raw = files.read_exports(spark, export_folder(spark, sf_dir), settle_for(spark, "raw"))
    keys = {"LFB1": ("LIFNR", "AKONT"), "KNBK": ("KUNNR", "KOINH"), "BSAK": ("BELNR", "XBLNR"),
            "T001": ("BUKRS", "BUTXT")}
    parts = [
        raw[t].groupBy(F.lit(t).alias("table"), F.col(k).alias("key"), F.col(v).alias("value"))
        .agg(F.count("*").alias("n")) for t, (k, v) in keys.items()
    ]
    return run.documents_union(parts)


@query
def raw_row_numbers(spark, sf_dir):
    """Line numbers are without gap and repetition in every export."""
    _, raw = files.read_exports(spark, export_folder(spark, sf_dir), settle_for(spark, "raw"))
    parts = [
        df.select(F.lit(t).alias("table"), "_row_no") for t, df in raw.items()
    ]
    return run.documents_union(parts).groupBy("table").agg(
        F.count("*").alias("n"), F.min("_row_no").alias("first"), F.max("_row_no").alias("last"),
        F.countDistinct("_row_no").alias("different"))


@query
def header_check(spark, sf_dir):
    """Columns of the exports against the mapping."""
    probed = files.probe(spark, export_folder(spark, sf_dir))
    columns = probed.select("table", F.explode(F.split("header", "[\t;]")).alias("column"))
    return check_header(columns.distinct())


# -- staging and canonical tables ---------------------------------------------------------------

@query
def stage_counts(spark, sf_dir):
    staged = prepared(spark, sf_dir).staged
    return run.documents_union([staging.stage_counts(s) for s in staged.values()])


@query
def control_totals(spark, sf_dir):
    staged = prepared(spark, sf_dir).staged
    return run.documents_union([
        staging.control_totals(staged[t]).select(F.lit(t).alias("table"), "*")
        for t in ("BSAD", "BSAK", "BSID", "BSIK")])


@query
def staged_rejects(spark, sf_dir):
    staged = prepared(spark, sf_dir).staged
    return run.documents_union([s.rejects for s in staged.values()]).select(
        "stage", "source_table", "row_no", "reason",
        F.length("raw_excerpt").between(1, 200).alias("has_excerpt"))


@query
def staged_items(spark, sf_dir):
    staged = prepared(spark, sf_dir).staged
    return run.documents_union([
        staged[t].rows.select(
            F.lit(t).alias("source"), "BELNR", "BUZEI", "BUDAT", "WRBTR", "amount_signed_local",
            "XBLNR", "reference_norm", "AUGDT")
        for t in ("BSAD", "BSAK", "BSID", "BSIK")])


def _canonical(name: str, *columns: str) -> None:
    def table(spark, sf_dir):
        return model(spark, sf_dir)[name].select(*columns)

    table.__name__ = f"canonical_{name}"
    query(table)


_canonical("company_code", "company_code", "name", "currency", "country")
_canonical("business_partner", "bp_key", "role", "source_id", "name1", "country", "city",
           "postal_code", "street", "is_one_time", "deletion_flag", "central_block",
           "alt_payer_key", "created_on", "email")
_canonical("bp_tax_id", "bp_key", "tax_id_type", "value", "value_norm")
_canonical("bp_company_code", "bp_key", "company_code", "payment_terms", "posting_block",
           "deletion_flag", "double_invoice_check", "alt_payer_key")
_canonical("bp_bank_account", "bp_key", "bank_key", "account_number", "partner_bank_type", "iban",
           "iban_norm", "iban_valid", "valid_from")
_canonical("bp_partner_function", "bp_key", "function", "partner_bp_key", "counter")
_canonical("bp_dunning", "bp_key", "company_code", "dunning_level", "last_dunned_on")
_canonical("payment_terms", "terms_key", "day_limit", "days1", "pct1", "days3", "description")
_canonical("fi_item", "item_key", "bp_key", "company_code", "fiscal_year", "posting_date",
           "doc_type", "debit_credit", "special_gl", "currency", "amount_doc",
           "amount_signed_local", "reference", "reference_norm", "payment_terms",
           "cash_disc_days1", "cash_disc_pct1", "cash_disc_base", "cash_disc_taken",
           "clearing_date", "is_open")


@query
def canonical_rejects(spark, sf_dir):
    return prepared(spark, sf_dir).canonical.rejects().select(
        "stage", "source_table", "row_no", "reason")


@query
def conservation(spark, sf_dir):
    return canonical.conservation(prepared(spark, sf_dir).canonical)


def _scoped(spark, sf_dir, scope: canonical.Scope) -> DataFrame:
    rows = {n: s.rows for n, s in prepared(spark, sf_dir).staged.items()}
    scoped = canonical.build_canonical(rows, scope, settle_for(spark, "scoped"))
    return canonical.conservation(scoped)


@query
def scope_company_codes(spark, sf_dir):
    return _scoped(spark, sf_dir, canonical.Scope(company_codes=("1000",)))


@query
def scope_side(spark, sf_dir):
    return _scoped(spark, sf_dir, canonical.Scope(side="ar"))


@query
def scope_posting_window(spark, sf_dir):
    return _scoped(spark, sf_dir, canonical.Scope(
        item_window_from=dt.date(1997, 1, 1), item_window_to=dt.date(1999, 12, 31)))


@query
def delivered_window(spark, sf_dir):
    return canonical.delivered_window(
        {n: s.rows for n, s in prepared(spark, sf_dir).staged.items()})


@query
def email_choice(spark, sf_dir):
    return canonical.emails(prepared(spark, sf_dir).staged["ADR6"].rows)


@query
def iban_choice(spark, sf_dir):
    return canonical.ibans(prepared(spark, sf_dir).staged["TIBAN"].rows).select(
        "bank_key", "account_number", "iban_norm", "iban_valid", "valid_from", "ambiguous")


@query
def iban_validity(spark, sf_dir):
    return canonical.ibans(prepared(spark, sf_dir).staged["TIBAN"].rows).select(
        "iban_norm", bank.iban_valid(F.col("iban_norm")).alias("valid"),
        bank.iban_mask(F.col("iban_norm")).alias("masked"))


@query
def terms_text_choice(spark, sf_dir):
    return canonical.terms_texts(prepared(spark, sf_dir).staged["T052U"].rows)


@query
def terms_text(spark, sf_dir):
    return master_data.terms_text(model(spark, sf_dir)["payment_terms"])


@query
def unknown_vat_prefixes(spark, sf_dir):
    return canonical.unknown_vat_prefixes(model(spark, sf_dir)["bp_tax_id"])


@query
def tiered_terms(spark, sf_dir):
    return canonical.tiered_terms(model(spark, sf_dir)["payment_terms"])


# -- relevance -----------------------------------------------------------------------------

@query
def house_currency(spark, sf_dir):
    return relevance.house_currency(model(spark, sf_dir)["company_code"])


@query
def data_as_of(spark, sf_dir):
    return relevance.data_as_of(model(spark, sf_dir)["fi_item"])


@query
def partner_relevance(spark, sf_dir):
    return model(spark, sf_dir)["bp_relevance"]


@query
def relevance_totals(spark, sf_dir):
    return relevance.relevance_totals(model(spark, sf_dir)["bp_relevance"])


@query
def status_distribution(spark, sf_dir):
    return relevance.status_distribution(model(spark, sf_dir)["bp_relevance"])


@query
def unclassified_doc_types(spark, sf_dir):
    m = model(spark, sf_dir)
    return relevance.unclassified_doc_types(m["business_partner"], m["fi_item"])


@query
def doc_type_membership(spark, sf_dir):
    """Items of the classes invoice and credit memo, combined, per side."""
    m = model(spark, sf_dir)
    parts = [
        m["fi_item"].filter(F.col("doc_type").isin(
            *relevance.doc_types(side, "invoice", "credit_memo")))
        .groupBy(F.lit(side).alias("side"), "doc_type").agg(F.count("*").alias("n"))
        for side in ("AR", "AP")]
    return run.documents_union(parts)


@query
def dunning_levels(spark, sf_dir):
    m = model(spark, sf_dir)
    return relevance.dunning_levels(
        m["fi_item"].filter(F.col("bp_key").startswith("C:")), m.as_of)


# -- checks ----------------------------------------------------------------------------------

def flat(results: DataFrame) -> DataFrame:
    """Contract rows without their nested parts."""
    names = ["bp_key", "role", "company_code", "source_table", "source_field", "current_value",
             "current_display", "proposed_value", "proposed_display", "source_summary", "tier",
             "impact_amount", "impact_currency", "impact_formula", "finding_key"]
    return results.select(*names)


def _check(rule_id: str) -> None:
    def check(spark, sf_dir):
        return flat(RULE_BY_ID[rule_id].check(model(spark, sf_dir)))

    check.__name__ = "check_" + rule_id.lower().replace("-", "_")
    query(check)


for _rule in RULES:
    _check(_rule.id)


@query
def invoice_terms(spark, sf_dir):
    return master_data.invoice_terms(model(spark, sf_dir))


@query
def open_invoices(spark, sf_dir):
    return items.open_invoices(model(spark, sf_dir))


@query
def discount_buckets(spark, sf_dir):
    return items.discount_buckets(model(spark, sf_dir))


@query
def shared_iban_members(spark, sf_dir):
    members = bank_data.shared_iban_members(model(spark, sf_dir))
    return members.select("iban_norm", "bp_key")


@query
def payer_links(spark, sf_dir):
    return bank_data.payer_links(model(spark, sf_dir))


@query
def cross_role_values(spark, sf_dir):
    return cross_role.cross_role_values(model(spark, sf_dir))


@query
def cross_role_members(spark, sf_dir):
    return cross_role.cross_role_members(model(spark, sf_dir))


@query
def netted_invoices(spark, sf_dir):
    """Paid invoices that are followed by a credit memo of their amount."""
    m = model(spark, sf_dir)
    return double_payment.not_netted(double_payment.paid_invoices(m), m).filter("netted").select(
        "item_key", "document_date", "amount_doc")


@query
def vat_without_pattern(spark, sf_dir):
    """VAT ids that match no row of the pattern table, by prefix (a join on a predicate)."""
    m = model(spark, sf_dir)
    rows = [(p, text.whole_text_pattern(v)) for p, v in VAT_PATTERNS.items()]
    patterns = F.broadcast(spark.createDataFrame(rows, "prefix string, pattern string"))
    values = m["bp_tax_id"].filter("tax_id_type = 'VAT'").select(
        "bp_key", "value_norm", text.vat_prefix(F.col("value_norm")).alias("prefix"))
    # every pattern starts with its prefix, so the join needs to test one pattern per value
    known = values.join(patterns, "prefix", "left").filter(
        ~F.coalesce(F.expr("value_norm RLIKE pattern"), F.lit(False)))
    return known.select("bp_key", "value_norm")


@query
def reject_candidates_null_safe(spark, sf_dir):
    """Vendor company rows where the flag is not true: NULL counts as not set."""
    return model(spark, sf_dir)["bp_company_code"].groupBy(
        F.col("double_invoice_check").eqNullSafe(F.lit(True)).alias("is_set")
    ).agg(F.count("*").alias("n"))


# -- findings ----------------------------------------------------------------------------------

def _brief(df: DataFrame) -> DataFrame:
    return df.select(
        "finding_id", "rule_id", "side", "category", "severity", "damage_class", "tier",
        "action_type", F.col("entity.bp_key").alias("bp_key"),
        F.col("entity.company_code").alias("company_code"),
        F.col("entity.display_name").alias("display_name"),
        F.col("current.value").alias("current_value"),
        F.col("proposed.value").alias("proposed_value"),
        F.col("impact_eur.amount").alias("impact"), "status")


@query
def all_checks(spark, sf_dir):
    """The findings of every check, enriched and identified."""
    return _brief(all_findings(spark, sf_dir))


@query
def finding_relevance(spark, sf_dir):
    return all_findings(spark, sf_dir).select(
        "finding_id", "relevance.open_items", "relevance.volume_12m", "relevance.currency",
        "relevance.last_activity_on")


@query
def finding_titles(spark, sf_dir):
    return all_findings(spark, sf_dir).groupBy("rule_id").agg(
        F.count("title").alias("titles"), F.max(F.length("title") <= 120).alias("short"),
        F.max(F.contains("title", F.lit("{"))).alias("unfilled"))


@query
def finding_violations(spark, sf_dir):
    """Findings made invalid on purpose: bank data in tier A, mass changes in tier C."""
    broken = all_findings(spark, sf_dir).withColumn("tier", F.when(
        F.col("damage_class") == 1, F.lit("A")).when(
        F.col("action_type") == "mass_change", F.lit("C")).otherwise(F.col("tier")))
    return findings.violations(broken)


@query
def finding_collisions(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    twice = found.unionByName(found.filter("category = 'leakage'"))
    return findings.collisions(twice)


@query
def duplicate_finding_ids(spark, sf_dir):
    found = all_findings(spark, sf_dir).select("finding_id", "category", "tier")
    two = found.select("finding_id", F.lit("a.json").alias("file")).unionByName(
        found.filter("tier = 'B'").select("finding_id", F.lit("b.json").alias("file")))
    return findings.duplicate_ids_across_files(two).select(
        "finding_id", "n", F.array_join("files", ",").alias("files"))


# -- decisions -------------------------------------------------------------------------------

def _digit() -> Column:
    return F.substring("finding_id", 3, 1)


def _memory(found: DataFrame) -> DataFrame:
    """Entries for findings whose id starts with a digit, and orphans for 'a'."""
    reason = F.when(_digit() < "2", F.lit("accepted_risk")).when(
        _digit() < "5", F.lit("data_correct")).otherwise(F.lit("not_relevant"))
    orphan = F.concat(F.lit("F-x"), F.substring("finding_id", 4, 11))
    return found.filter(_digit() <= "a").select(
        F.when(_digit() == "a", orphan).otherwise(F.col("finding_id")).alias("finding_id"),
        "rule_id", F.col("entity.bp_key").alias("bp_key"), F.lit("Prüfer").alias("decided_by"),
        F.lit("2026-01-02T10:00:00").alias("decided_at"), reason.alias("reason_code"),
        F.lit("geprüft").alias("reason"))


@query
def memory_applied(spark, sf_dir):
    found = all_findings(spark, sf_dir).drop("finding_key", "problem")
    applied = decisions.apply_memory(found, decisions.typed_memory(_memory(found)))
    return applied.select("finding_id", "status", F.col("decision.reason_code").alias(
        "reason_code"), F.col("decision.at").alias("at"))


@query
def memory_summary(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    return decisions.memory_summary(found, _memory(found))


@query
def memory_orphans(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    return decisions.orphans(found, _memory(found))


@query
def memory_problems(spark, sf_dir):
    """Entries spoilt on purpose: a reason nobody knows, no time, no reason."""
    memory = _memory(all_findings(spark, sf_dir))
    spoilt = memory.withColumns({
        "reason_code": F.when(_digit() == "3", F.lit("maybe")).otherwise(F.col("reason_code")),
        "decided_at": F.when(_digit() == "4", F.lit("soon")).otherwise(F.col("decided_at")),
        "reason": F.when(_digit() != "5", F.col("reason")),
    })
    return decisions.memory_problems(spoilt.unionByName(spoilt.filter(_digit() == "6")))


@query
def memory_mismatches(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    moved = _memory(found).withColumn("rule_id", F.when(
        _digit() == "7", F.lit("AR-VAL-004")).otherwise(F.col("rule_id")))
    return decisions.memory_mismatches(found, moved)


@query
def memory_round_trip(spark, sf_dir):
    """Decision memory: a file of entries, read, typed, and kept as a table."""
    folder = work_folder(spark, "memory")
    documents.write_json(_memory(all_findings(spark, sf_dir)), f"{folder}/decisions")
    memory = decisions.typed_memory(documents.read_memory_file(spark, f"{folder}/decisions"))
    documents.write_memory(memory, f"{folder}/table")
    return documents.read_memory(spark, f"{folder}/table")


def _records(found: DataFrame) -> DataFrame:
    """Explorer records by the first character of the id."""
    action = F.when(_digit() < "5", F.lit("accept")).when(
        _digit() < "8", F.lit("assign")).otherwise(F.lit("reject"))
    choices = found.filter(_digit() < "c").select(
        "finding_id", action.alias("action"),
        F.when(_digit() == "8", F.lit("accepted_risk")).when(
            _digit() == "9", F.lit("data_correct")).alias("reason_code"),
        F.when(_digit() == "1", F.lit(" eigener Grund ")).alias("reason"),
        F.when(_digit() == "6", F.lit("Kollegin")).alias("assigned_to"),
        F.lit(None).cast("string").alias("chosen_option"),
        F.lit(" Prüfer ").alias("by"), F.lit("2026-01-02T10:00:00Z").alias("at"))
    return decisions.create_records(choices)


@query
def decision_records(spark, sf_dir):
    return _records(all_findings(spark, sf_dir))


@query
def decision_overlay(spark, sf_dir):
    found = all_findings(spark, sf_dir).drop("finding_key", "problem")
    return decisions.overlay(found, _records(found)).select(
        "finding_id", "status", F.col("decision.reason").alias("reason"))


@query
def decision_problems(spark, sf_dir):
    records = _records(all_findings(spark, sf_dir)).withColumns({
        "action": F.when(_digit() == "2", F.lit("ponder")).otherwise(F.col("action")),
        "at": F.when(_digit() == "3", F.lit("2026-01-02T10:00:00+02:00")).otherwise(F.col("at")),
    })
    return decisions.record_problems(records)


@query
def decision_import(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    some = found.filter("category <> 'leakage'")
    path = work_folder(spark, "decision-file")
    sample, records = sampling.draw_sample(found), _accepting(found)
    progress = sampling.sample_progress(sample, records)
    at = "2026-01-02T10:00:00Z"
    reviews = sampling.group_reviews(progress, "Prüfer", at)
    documents.write_decision_file(
        path, documents.run_info(found).withColumn("run_id", F.lit("other-run")), _records(found),
        reviews, sampling.review_ids(reviews, sample, sampling.group_release(
            found, progress, records, "Prüfer", at), found), " Prüfer ", at)
    parts = documents.read_decision_file(spark, path)
    return decisions.import_report(parts["decisions"], some, parts["header"].first()["run_id"],
                                   parts["sample_reviewed"])


@query
def decision_file(spark, sf_dir):
    """Parts and rows of a decisions export as it is read back."""
    found = all_findings(spark, sf_dir)
    path = work_folder(spark, "decision-file")
    none = found.filter(F.lit(False))
    reviews = sampling.group_reviews(
        sampling.sample_progress(sampling.draw_sample(none), _accepting(none)), "P", "t")
    ids = sampling.review_ids(reviews, sampling.draw_sample(none), none, none)
    documents.write_decision_file(path, documents.run_info(found), _records(found), reviews, ids,
                                  " P ", "2026-01-02T10:00:00Z")
    parts = documents.read_decision_file(spark, path)
    head = parts["header"].select("format", "format_version", "run_id", "data_as_of",
                                  "exported_at", "exported_by")
    return head.crossJoin(parts["decisions"].agg(F.count("*").alias("decisions"))).crossJoin(
        parts["sample_reviewed"].agg(F.count("*").alias("reviews")))


@query
def decision_import_missing(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    return decisions.import_records(
        _records(found), found.filter("category <> 'leakage'"))[1]


@query
def decision_round_trip(spark, sf_dir):
    path = work_folder(spark, "decisions")
    documents.write_decisions(_records(all_findings(spark, sf_dir)), path)
    return documents.read_decisions(spark, path)


@query
def decision_log(spark, sf_dir):
    """The last click per user of the event stream; an error clears what was there."""
    log = _read(spark, sf_dir, "events").select(
        F.concat(F.lit("F-"), F.col("user_id")).alias("finding_id"),
        F.struct("ts", "event_id").alias("at"),
        F.when(F.col("event_type") == "error", F.lit("clear")).otherwise(F.col("event_type"))
        .alias("action"))
    return decisions.latest_records(log).select("finding_id", "action",
                                                F.col("at.event_id").alias("event_id"))


@query
def cleanup_list(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    return decisions.cleanup_list(found, _records(found))


@query
def cleanup_round_trip(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    path = work_folder(spark, "cleanup")
    documents.write_cleanup_csv(decisions.cleanup_list(found, _records(found)), path)
    return documents.read_cleanup_csv(spark, path).fillna("")


# -- exploration -----------------------------------------------------------------------------

@query
def filter_findings(spark, sf_dir):
    filters = explore.Filters(side="AR", severity="high", status="open")
    return _brief(explore.matching(all_findings(spark, sf_dir), filters))


@query
def filter_no_company_code(spark, sf_dir):
    filters = explore.Filters(company_code="none", tier="B")
    return _brief(explore.matching(all_findings(spark, sf_dir), filters))


@query
def search_findings(spark, sf_dir):
    return _brief(explore.matching(all_findings(spark, sf_dir), search=" ORT 1"))


@query
def visible_findings(spark, sf_dir):
    return _brief(explore.visible(
        all_findings(spark, sf_dir), "decision", explore.Filters(side="AR"), "ar-con"))


@query
def sorted_by_tier(spark, sf_dir):
    """Rank columns a list sorted by tier is ordered by."""
    found = all_findings(spark, sf_dir)
    return found.orderBy(*explore.sort_keys("tier", False)).select(
        "finding_id", explore.rank(F.col("tier"), TIERS).alias("tier_rank"),
        explore.rank(F.col("severity"), SEVERITIES).alias("severity_rank"),
        explore.rank(F.col("status"), STATUSES).alias("status_rank"))


@query
def top_findings(spark, sf_dir):
    return _brief(explore.top(all_findings(spark, sf_dir)))


@query
def company_code_options(spark, sf_dir):
    return explore.company_code_options(all_findings(spark, sf_dir))


@query
def overview(spark, sf_dir):
    return explore.overview(all_findings(spark, sf_dir))


@query
def tier_counts(spark, sf_dir):
    return explore.by_tier(all_findings(spark, sf_dir))


@query
def tab_counts(spark, sf_dir):
    return explore.by_action_type(all_findings(spark, sf_dir), explore.Filters(side="AP"))


@query
def totals_by_currency(spark, sf_dir):
    return explore.totals_by_currency(all_findings(spark, sf_dir))


@query
def category_totals(spark, sf_dir):
    return explore.totals_by_currency(all_findings(spark, sf_dir), "category")


@query
def category_summary(spark, sf_dir):
    return explore.ordered_categories(all_findings(spark, sf_dir)).select(
        "category", "n", "without_impact")


@query
def rule_groups(spark, sf_dir):
    return explore.rule_groups(all_findings(spark, sf_dir)).drop("title", "rule_version")


@query
def finding_flags(spark, sf_dir):
    return all_findings(spark, sf_dir).select(
        "finding_id", explore.is_open().alias("open"), explore.has_relevance().alias("relevant"),
        explore.is_releasable().alias("releasable"),
        explore.accept_blocked(F.lit(None).cast("string")).alias("blocked"))


@query
def sorted_evidence(spark, sf_dir):
    """Evidence with contradictions first."""
    ordered = all_findings(spark, sf_dir).select(
        "finding_id", "rule_id", explore.sorted_evidence(F.col("evidence")).alias("evidence"))
    return ordered.filter(F.size("evidence") > 1).select(
        "finding_id", "rule_id",
        F.array_join(F.transform("evidence", lambda e: e["agrees"].cast("string")), ",")
        .alias("agrees"))


@query
def match_reasons(spark, sf_dir):
    """Reasons and notes of a match model, over evidence rewritten to carry them."""
    spoken = F.transform("evidence", lambda e: e.withField("source_type", F.lit("model"))
                         .withField("value", F.lit(" Name , Adresse,,"))
                         .withField("note", F.lit("after Netting")))
    return all_findings(spark, sf_dir).select(
        "finding_id", F.array_join(explore.match_reasons(spoken), "|").alias("reasons"),
        explore.match_note(spoken).alias("note"), explore.netting_note(spoken).alias("netting"))


@query
def record_comparison(spark, sf_dir):
    return explore.record_comparison(model(spark, sf_dir), all_findings(spark, sf_dir)).select(
        "finding_id", "field", "low", "high", "differs", "missing")


@query
def finding_members(spark, sf_dir):
    """The accounts behind findings about several of them, one row per value and account."""
    m = model(spark, sf_dir)
    return bank_data.cluster_members(m).unionByName(cross_role.matched_members(m))


@query
def finding_values(spark, sf_dir):
    """Which values lead from a finding to its accounts."""
    m, found = model(spark, sf_dir), all_findings(spark, sf_dir)
    return bank_data.cluster_values(m, found).unionByName(
        cross_role.matched_values(m, found)).select("finding_id", "value_key")


@query
def document_pairs(spark, sf_dir):
    return explore.document_pairs(all_findings(spark, sf_dir)).select(
        "finding_id", "position", "document_key", "value", "observed_at")


# -- sampling --------------------------------------------------------------------------------

@query
def finding_sample(spark, sf_dir):
    return sampling.draw_sample(all_findings(spark, sf_dir))


@query
def sample_progress(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    return sampling.sample_progress(sampling.draw_sample(found), _records(found))


def _accepting(found: DataFrame) -> DataFrame:
    """Records that accept the whole sample of every rule but the leakage ones."""
    sample = sampling.draw_sample(found)
    return sample.filter(~F.col("rule_id").contains("LEA")).select(
        "finding_id", F.lit("accept").alias("action"))


@query
def group_release(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    records = _accepting(found)
    progress = sampling.sample_progress(sampling.draw_sample(found), records)
    return sampling.group_release(found, progress, records, " Prüfer ", "2026-01-02T10:00:00Z")


@query
def group_reviews(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    progress = sampling.sample_progress(sampling.draw_sample(found), _accepting(found))
    return sampling.group_reviews(progress, "Prüfer", "2026-01-02T10:00:00Z")


@query
def review_ids(spark, sf_dir):
    """The sampled and applied findings of every review."""
    found = all_findings(spark, sf_dir)
    sample, records = sampling.draw_sample(found), _accepting(found)
    progress = sampling.sample_progress(sample, records)
    at = "2026-01-02T10:00:00Z"
    return sampling.review_ids(
        sampling.group_reviews(progress, "Prüfer", at), sample,
        sampling.group_release(found, progress, records, "Prüfer", at), found)


# -- expectation against run -------------------------------------------------------------------

@query
def compare_runs(spark, sf_dir):
    """Findings against an expectation that differs in every way there is."""
    found = all_findings(spark, sf_dir)
    actual = compare.actual_keys(found)
    keyed = found.select(
        "rule_id", F.col("entity.bp_key").alias("bp_key"),
        F.when((F.col("rule_id") == "AR-CON-002") & (_digit() < "4"), F.lit("9000"))
        .otherwise(F.col("entity.company_code")).alias("company_code"),
        "finding_key", _digit().alias("digit"))
    late = F.when(F.col("digit") == "e", F.lit("1.10")).when(F.col("digit") == "d", F.lit("0.9"))
    expected = keyed.filter("digit <> 'f'").withColumn("from_rule_version", late)
    gone = expected.filter("digit = '0'").withColumn(
        "bp_key", F.concat("bp_key", F.lit("X"))).withColumn(
        "from_rule_version", F.when(F.col("rule_id") == "AR-VAL-001", F.lit("2.0")))
    unbuilt = expected.filter("digit = '1'").withColumn("rule_id", F.lit("AR-DUP-001")).dropDuplicates(
        ["bp_key"]).withColumn("from_rule_version", F.lit(None).cast("string"))
    versions = spark.createDataFrame([(r.id, r.version) for r in RULES],
                                     "rule_id string, version string")
    every = expected.unionByName(gone).unionByName(unbuilt).drop("digit")
    result = compare.compare(every, actual, versions, settle_for(spark, "compare"))
    return result.groupBy("bucket", "rule_id").agg(F.count("*").alias("n"))


# -- report ------------------------------------------------------------------------------------

@query
def reject_reasons(spark, sf_dir):
    return report.reject_reasons(prepared(spark, sf_dir).rejects())


@query
def top_reject_reasons(spark, sf_dir):
    return report.top_reasons(prepared(spark, sf_dir).rejects())


@query
def rule_outcomes(spark, sf_dir):
    """Outcomes of a run without the terms table and with one broken check: two rules are
    skipped, one fails, the others run."""
    m = model(spark, sf_dir)
    tables = {n: df for n, df in m.tables.items() if n != "payment_terms"}
    without = Model(tables, m.as_of, m.window_from, m.thresholds)

    def broken(part: Model) -> DataFrame:
        return RULE_BY_ID["AP-VAL-003"].check(part).withColumn(
            "current_value", F.raise_error(F.lit("broken on purpose")).cast("string"))

    rules = [replace(r, check=broken) if r.id == "AP-VAL-003" else r for r in RULES]
    found, told = run.check_all(without, CONTEXT, settle_for(spark, "outcomes"), rules)
    return report.rule_outcomes(found, told).select("rule_id", "status", "findings")


@query
def run_totals(spark, sf_dir):
    p = prepared(spark, sf_dir)
    counts = run.documents_union([staging.stage_counts(s) for s in p.staged.values()])
    found = all_findings(spark, sf_dir)
    outcomes = report.rule_outcomes(found, Outcomes([r.id for r in RULES]))
    return report.run_totals(counts, canonical.conservation(p.canonical), found, outcomes)


def _whole_run(spark, sf_dir) -> run.RunResult:
    """A run from export files, with a decision memory one entry of which is an orphan."""
    def build() -> run.RunResult:
        found = all_findings(spark, sf_dir)
        memory = _memory(found)
        return run.execute(spark, export_folder(spark, sf_dir), work_folder(spark, "runs"),
                           CONTEXT.created_at, memory=memory)

    return _once(spark, sf_dir, "whole_run", build)


@query
def run_hints(spark, sf_dir):
    """What a whole run says that is no problem; columns not delivered are those of the derived
    exports and are left out."""
    result = _whole_run(spark, sf_dir)
    result.outcomes.refuse_gaps()
    return result.tables["hints"].filter(
        "source <> 'mapped column not delivered'").select("source", "key", "n")


@query
def run_summary(spark, sf_dir):
    """The summary of a whole run as it is read back; it agrees with the findings."""
    result = _whole_run(spark, sf_dir)
    problems = report.summary_problems(result.tables["findings"], result.tables["summary"])
    n = problems.agg(F.count("*").alias("problems"))
    return result.tables["summary"].select(
        "findings", "rules_executed", "rules_skipped", "rules_failed", "outcome").crossJoin(n)


@query
def run_info(spark, sf_dir):
    return documents.run_info(all_findings(spark, sf_dir)).withColumn(
        "company_codes", F.array_join("company_codes", ","))


@query
def findings_round_trip(spark, sf_dir):
    """Findings written as lines and read again."""
    path = work_folder(spark, "findings-json")
    documents.write_findings(all_findings(spark, sf_dir), path)
    return _brief(documents.read_findings(spark, path))


@query
def findings_file_problems(spark, sf_dir):
    found = all_findings(spark, sf_dir)
    spoilt = found.withColumns({
        "title": F.when(_digit() != "1", F.col("title")),
        "action_type": F.when(_digit() == "2", F.lit("ponder")).otherwise(F.col("action_type")),
        "run_id": F.when(_digit() == "3", F.lit("other-run")).otherwise(F.col("run_id")),
    })
    return documents.findings_file_problems(spoilt)


@query
def full_run(spark, sf_dir):
    """From export files to findings, through every stage."""
    result = run.execute(
        spark, export_folder(spark, sf_dir), work_folder(spark, "runs"), CONTEXT.created_at)
    result.outcomes.refuse_gaps()
    return _brief(result.tables["findings"])
