"""Checks of the rule catalogue beside the client's 17: what master data lacks or contradicts,
cash discount granted too late, payments to blocked vendors.

Their rows have the contract columns.  Items are summed per account before they meet master data,
so a hot account costs one row; master data is only joined with itself by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck import fixed
from ledgercheck.checks.bank_data import shared_iban_clusters
from ledgercheck.checks.contract import Model, contract, evidence, params
from ledgercheck.checks.vat import MASTER
from ledgercheck.functions import dates, numbers
from ledgercheck.functions.bank import iban_mask
from ledgercheck.functions.text import said
from ledgercheck.operators.relevance import doc_types
from ledgercheck.schema import MONEY

COMPANY = {"CUSTOMER": "KNB1", "VENDOR": "LFB1"}


# -- completeness --------------------------------------------------------------------------

def vat_missing(model: Model, role: str) -> DataFrame:
    """A partner in another country of the EU has no VAT id.

    Customers of an account group in the threshold `b2b_groups` need one in the home country as
    well."""
    known = model["bp_tax_id"].filter((F.col("tax_id_type") == "VAT")
                                      & (F.trim("value_norm") != ""))
    country = F.col("country")
    needed = country.isin(*fixed.EU_COUNTRIES) & (country != model.thresholds.get("home", "DE"))
    groups = model.thresholds.get("b2b_groups", ())
    if role == "CUSTOMER" and groups:
        needed = needed | F.col("account_group").isin(*groups)
    found = model.partners(role, "role", "country", "account_group").filter(needed).join(
        known, "bp_key", "left_anti")
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table=MASTER[role],
        source_field="STCEG",
        current_display=said(fixed.VAT_MISSING, country=F.coalesce(country, F.lit("–"))),
        evidence=F.array(evidence("deterministic", f"{MASTER[role]}.LAND1", country, False,
                                  said(fixed.VAT_MISSING, country=F.coalesce(country, F.lit("–"))),
                                  kind="master_field")),
        params=params(country=country))


def bank_missing(model: Model, role: str) -> DataFrame:
    """A company row pays or collects by bank, and the partner has no bank account."""
    methods = model.thresholds.get("bank_methods", {
        "CUSTOMER": fixed.DIRECT_DEBIT_METHODS, "VENDOR": fixed.TRANSFER_METHODS}[role])
    by_bank = F.col("payment_methods").rlike("[" + "".join(methods) + "]")
    found = model["bp_company_code"].filter(by_bank).select(
        "bp_key", "company_code", "payment_methods").join(
        model.partners(role, "role"), "bp_key").join(
        model["bp_bank_account"], "bp_key", "left_anti")
    display = said(fixed.BANK_MISSING, methods=F.col("payment_methods"))
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table=COMPANY[role], source_field="ZWELS", current_value=F.col("payment_methods"),
        current_display=display,
        evidence=F.array(evidence("deterministic", "bp_bank_account", "–", False, display,
                                  kind="master_field")),
        params=params(company_code=F.col("company_code")))


def dunning_missing(model: Model) -> DataFrame:
    """An active customer has no dunning procedure in a company code."""
    procedure = F.lit(model.thresholds.get("dunning_procedure", "0001"))
    active = model["bp_relevance"].filter("activity_status = 'active'")
    found = model["bp_company_code"].filter(
        F.coalesce(F.trim("dunning_procedure"), F.lit("")) == "").select(
        "bp_key", "company_code").join(model.partners("CUSTOMER", "role"), "bp_key").join(
        active, "bp_key", "left_semi")
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table="KNB5", source_field="MAHNA", current_display=fixed.DUNNING_MISSING,
        proposed_value=procedure,
        proposed_display=said(fixed.DUNNING_PROPOSAL, procedure=procedure), tier="A",
        evidence=F.array(evidence("deterministic", "bp_company_code", "–", False,
                                  fixed.DUNNING_MISSING, kind="policy")),
        params=params(company_code=F.col("company_code")))


# -- validity and consistency ----------------------------------------------------------------

def _fits_country(code: Column, country: Column) -> Column:
    """Whether a postal code has the form of its country; NULL where no form is known."""
    fits = F.lit(None).cast("boolean")
    for name, pattern in fixed.POSTAL_CODE_PATTERNS.items():
        fits = F.when(country == name, code.rlike(pattern)).otherwise(fits)
    return fits


def postal_code(model: Model) -> DataFrame:
    """A customer's postal code does not have its country's form; an empty one is not judged."""
    code, country = F.trim("postal_code"), F.col("country")
    found = model.partners("CUSTOMER", "role", "country", "postal_code").filter(
        (code != "") & ~_fits_country(code, country))
    display = said(fixed.POSTAL_WRONG, country=country)
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table="KNA1",
        source_field="PSTLZ", current_value=F.col("postal_code"), current_display=display,
        evidence=F.array(evidence("deterministic", "postal_code_patterns", country, False, display,
                                  kind="policy")),
        params=params(country=country))


def terms_deviate(model: Model) -> DataFrame:
    """More than `deviating_percent` of a customer's invoices carry other terms than the master.

    At least `min_invoices` invoices; the proposal is the most frequent terms, ties to the least
    key.  Invoices are counted per terms key before the master row is joined."""
    least = model.thresholds.get("min_invoices", 3)
    percent = model.thresholds.get("deviating_percent", 70)
    counted = model["fi_item"].filter(
        F.col("doc_type").isin(*doc_types("AR", "invoice")) & F.col("payment_terms").isNotNull()
    ).groupBy("bp_key", "company_code", F.col("payment_terms").alias("used")).agg(
        F.count("*").alias("n"))
    master = model["bp_company_code"].filter(F.col("payment_terms").isNotNull()).select(
        "bp_key", "company_code", "payment_terms").join(
        model.partners("CUSTOMER", "role"), "bp_key")
    found = counted.join(master, ["bp_key", "company_code"]).groupBy(
        "bp_key", "company_code", "role", "payment_terms").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(F.col("used") != F.col("payment_terms"), F.col("n")).otherwise(0))
        .alias("other"),
        F.min(F.struct((-F.col("n")).alias("order"), F.col("used"))).alias("top")).filter(
        (F.col("all") >= least) & (F.col("other") * 100 > F.col("all") * percent))
    top, n = F.col("top.used"), (-F.col("top.order")).cast("string")
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table="KNB1", source_field="ZTERM", current_value=F.col("payment_terms"),
        current_display=said(fixed.TERMS_DEVIATE, n=F.col("other"), all=F.col("all")),
        proposed_value=top,
        source_summary=said(fixed.TERMS_USED, n=n, all=F.col("all"), terms=top),
        evidence=F.array(evidence("invoice", F.col("company_code"), top, False, said(
            fixed.TERMS_USED, n=n, all=F.col("all"), terms=top), kind="document")),
        params=params(company_code=F.col("company_code")))


def bank_abroad(model: Model, role: str) -> DataFrame:
    """An IBAN is of another country than the partner; a hint, one row per bank account."""
    bank, country = F.substring("iban_norm", 1, 2), F.col("country")
    found = model["bp_bank_account"].filter(bank.rlike("^[A-Z]{2}")).select(
        "bp_key", "bank_key", "account_number", "iban_norm").join(
        model.partners(role, "role", "country"), "bp_key").filter(bank != country)
    masked = iban_mask(F.col("iban_norm"))
    display = said(fixed.BANK_ABROAD, bank=bank, country=country)
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table="TIBAN",
        source_field="IBAN", current_value=masked, current_display=display,
        evidence=F.array(evidence("deterministic", f"{MASTER[role]}.LAND1", country, False,
                                  display, kind="master_field")),
        params=params(country=country, iban_masked=masked),
        finding_key=F.concat_ws("|", "bank_key", "account_number"))


def shared_iban_of_customers(model: Model) -> DataFrame:
    """One finding per IBAN of several customers none of which pays for another."""
    masked = iban_mask(F.col("iban_norm"))
    display = said(fixed.IBAN_OF_CUSTOMERS, n=F.col("accounts"))
    return contract(
        shared_iban_clusters(model, "CUSTOMER"), bp_key=F.col("anchor"), role="CUSTOMER",
        source_table="TIBAN", source_field="IBAN", current_value=masked, current_display=display,
        evidence=F.array(evidence("deterministic", fixed.PAYER_REFERENCE, fixed.PAYER_NONE, False,
                                  display, kind="master_field")),
        params=params(konten=F.col("accounts"), iban_masked=masked))


def never_posted(model: Model) -> DataFrame:
    """A customer created within the window, more than `months` months ago, without any item."""
    months, created = model.thresholds.get("months", 12), F.col("created_on")
    found = model.partners("CUSTOMER", "role", "created_on").filter(
        (created >= model.window_from) & (created < dates.months_back(model.as_of, months))).join(
        model["fi_item"].select("bp_key").distinct(), "bp_key", "left_anti")
    display = said(fixed.NEVER_POSTED, day=dates.date_text(created))
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table="KNA1",
        source_field="ERDAT", current_value=dates.iso_text(created), current_display=display,
        evidence=F.array(evidence("deterministic", "fi_item", "–", True, display,
                                  kind="document")),
        params=params(created_on=dates.date_text(created)))


# -- leakage and payments ----------------------------------------------------------------------

def late_discount(model: Model) -> DataFrame:
    """Cash discount a customer took after its period, per account and company code.

    The period is the item's own, else that of the lowest tier of its terms; items without
    either, or in another currency than the company's, are not judged."""
    terms = model["payment_terms"].groupBy("terms_key").agg(F.min(F.struct(
        F.coalesce("day_limit", F.lit(0)).alias("limit"), F.col("days1").alias("days")))
        .alias("tier")).select(F.col("terms_key").alias("payment_terms"),
                               F.col("tier.days").alias("terms_days"))
    house = model["company_code"].select("company_code", "currency")
    taken = model["fi_item"].filter(
        F.col("doc_type").isin(*doc_types("AR", "invoice")) & ~F.col("is_open")
        & (F.col("cash_disc_taken") > 0)).select(
        "bp_key", "company_code", "currency", "payment_terms", "cash_disc_days1",
        "baseline_date", "clearing_date", "cash_disc_taken")
    days = F.coalesce("cash_disc_days1", "terms_days")
    found = taken.join(house, ["company_code", "currency"], "left_semi").join(
        terms, "payment_terms", "left").filter(
        F.col("clearing_date") > F.date_add("baseline_date", days)).groupBy(
        "bp_key", "company_code", "currency").agg(
        F.count("*").alias("n"), F.sum("cash_disc_taken").cast(MONEY).alias("late")).join(
        model.partners("CUSTOMER", "role"), "bp_key")
    money = numbers.money(F.col("late"), F.col("currency"))
    display = said(fixed.DISCOUNT_LATE, n=F.col("n"))
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table="BSAD", source_field="SKNTO", current_value=F.col("late"),
        current_display=display,
        evidence=F.array(evidence("deterministic", F.col("company_code"), money, False, display,
                                  kind="document")),
        impact_amount=F.col("late"), impact_currency=F.col("currency"),
        impact_formula=fixed.DISCOUNT_LATE_FORMULA, params=params(invoices=F.col("n")))


def paid_though_blocked(model: Model) -> DataFrame:
    """Payments of the last `months` months to a vendor that is blocked or to be deleted."""
    months = model.thresholds.get("months", 12)
    paid = model["fi_item"].filter(
        F.col("doc_type").isin(*doc_types("AP", "payment"))
        & (F.col("posting_date") > dates.months_back(model.as_of, months))
        & (F.col("posting_date") <= model.as_of)).groupBy("bp_key", "company_code").agg(
        F.count("*").alias("n"), F.sum("amount_local").cast(MONEY).alias("paid"))
    rows = model["bp_company_code"].select(
        "bp_key", "company_code", F.col("deletion_flag").alias("row_deletion"), "posting_block")
    house = model["company_code"].select("company_code", "currency")
    found = paid.join(model.partners("VENDOR", "role", "deletion_flag", "central_block"),
                      "bp_key").join(rows, ["bp_key", "company_code"], "left").filter(
        "deletion_flag OR central_block OR coalesce(row_deletion, false) "
        "OR coalesce(posting_block, false)").join(house, "company_code", "left")
    display = said(fixed.PAID_BLOCKED, n=F.col("n"))
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table=F.expr("CASE WHEN deletion_flag OR central_block THEN 'LFA1' ELSE 'LFB1' END"),
        source_field=F.expr("CASE WHEN deletion_flag OR (row_deletion AND NOT central_block) "
                            "THEN 'LOEVM' ELSE 'SPERR' END"),
        current_value="X", current_display=display,
        evidence=F.array(evidence("deterministic", F.col("company_code"),
                                  numbers.money(F.col("paid"), F.col("currency")), False, display,
                                  kind="document")),
        impact_amount=F.col("paid"), impact_currency=F.col("currency"),
        impact_formula=fixed.PAID_BLOCKED_FORMULA.format(months=months),
        params=params(payments=F.col("n")))
