"""Postings: payments nobody applied, discounts nobody took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model, contract, document, evidence, params
from ledgercheck.checks.master_data import terms_text
from ledgercheck.functions import dates, numbers
from ledgercheck.operators.relevance import doc_types
from ledgercheck.schema import MONEY


def open_invoices(model: Model) -> DataFrame:
    """Open customer invoices per account and company code: the candidates to clear."""
    return (
        model["fi_item"]
        .filter((F.col("debit_credit") == "S") & F.col("is_open")
                & F.col("doc_type").isin(*doc_types("AR", "invoice")))
        .groupBy("bp_key", "company_code")
        .agg(F.count("*").alias("invoices"), F.sum("amount_doc").cast(MONEY).alias("total"),
             F.min("currency").alias("invoice_currency"))
    )


def unapplied_cash(model: Model) -> DataFrame:
    """A payment that is open, old enough, and tied to no invoice."""
    age = F.datediff(model.as_of, F.col("posting_date"))
    payments = (
        model["fi_item"]
        .filter(
            (F.col("debit_credit") == "H") & F.col("is_open")
            & F.col("doc_type").isin(*doc_types("AR", "payment"))
            & F.coalesce("special_gl", "reference_norm", "assignment", "invoice_ref_doc",
                         "clearing_doc").isNull()
            & F.col("clearing_date").isNull()
        )
        .withColumn("days", age)
        .filter(F.col("days") > model.thresholds.get("min_age_days", 30))
        .select("bp_key", "company_code", "fiscal_year", "document_no", "line_item",
                "posting_date", "document_date", "amount_doc", "currency", "days")
        .join(model["business_partner"].filter("role = 'CUSTOMER'").select("bp_key"),
              "bp_key", "left_semi")
    )
    found = payments.join(open_invoices(model), ["bp_key", "company_code"], "left").fillna(
        0, ["invoices"]
    )
    money = numbers.money(F.col("amount_doc"), F.col("currency"))
    total = numbers.money(F.col("total"), F.col("invoice_currency"))
    n, days = F.col("invoices").cast("string"), F.col("days").cast("string")
    several = F.concat(n, F.lit(" offene Rechnungen über "), total)
    reference = F.concat_ws("/", "company_code", "fiscal_year", "document_no")
    posted = dates.iso_text(F.col("posting_date"))
    return contract(
        found, bp_key=F.col("bp_key"), role="CUSTOMER", company_code=F.col("company_code"),
        source_table="BSID", source_field="XBLNR",
        current_display=F.concat(
            F.lit("Zahlungseingang über "), money, F.lit(" vom "),
            dates.date_text(F.col("posting_date")), F.lit(", seit "), days,
            F.lit(" Tagen ohne Rechnungsbezug und ohne Ausgleich")),
        proposed_display=F.when(
            F.col("invoices") > 0, F.lit("Zahlung einer offenen Rechnung zuordnen (F-32)")
        ).otherwise(F.lit("Keine offene Rechnung auf dem Konto – Rückzahlung veranlassen")),
        source_summary=F.concat(
            F.lit("Beleg "), "document_no",
            F.lit(": XBLNR, ZUONR und REBZG leer, kein Ausgleichsbeleg, "), days,
            F.lit(" Tage alt; "),
            F.when(F.col("invoices") == 0, F.lit("keine offene Rechnung im Buchungskreis"))
            .when(F.col("invoices") == 1, F.concat(F.lit("eine offene Rechnung über "), total))
            .otherwise(several)),
        evidence=F.array(
            evidence("deterministic", reference, money, True,
                     "Zahlungseingang, offen und ohne Rechnungsbezug", kind="document",
                     observed_at=posted),
            evidence("deterministic", F.concat(F.lit("BSID "), "company_code"),
                     F.when(F.col("invoices") == 0, F.lit("keine offene Rechnung"))
                     .otherwise(several),
                     F.col("invoices") > 0, "Kandidaten für die Zuordnung im selben Buchungskreis",
                     kind="document", observed_at=dates.iso_text(model.as_of))),
        documents=F.array(document(
            company_code=F.col("company_code"), fiscal_year=F.col("fiscal_year"),
            document_no=F.col("document_no"), line_item=F.col("line_item"),
            document_date=dates.iso_text(F.col("document_date")),
            amount=numbers.amount_text(F.col("amount_doc")), currency=F.col("currency"))),
        params=params(amount=money, days=F.col("days")),
        finding_key=F.col("document_no"),
    )


def _sum_if(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def discount_buckets(model: Model) -> DataFrame:
    """Per vendor and company code: discount lost, expired while open, and still to get."""
    months = model.thresholds.get("months", 12)
    house = model["company_code"].select("company_code", F.col("currency").alias("house"))
    invoices = (
        model["fi_item"]
        .filter(F.col("doc_type").isin(*doc_types("AP", "invoice"))
                & (F.col("posting_date") > dates.months_back(model.as_of, months))
                & (F.col("posting_date") <= model.as_of))
        .select("bp_key", "company_code", "currency", "payment_terms", "is_open",
                "cash_disc_pct1", "cash_disc_days1", "cash_disc_base", "cash_disc_taken",
                "baseline_date", "clearing_date")
        .join(house, "company_code")
    )
    rate, base = F.col("cash_disc_pct1"), F.col("cash_disc_base")
    due = F.date_add("baseline_date", F.col("cash_disc_days1"))
    agreed = (rate > 0) & base.isNotNull() & due.isNotNull() & (F.col("currency") == F.col("house"))
    is_open = F.col("is_open")
    marked = invoices.select(
        "bp_key", "company_code", "currency", "payment_terms", "cash_disc_days1", rate, base,
        (F.col("currency") == F.col("house")).alias("at_home"),
        ((F.col("currency") != F.col("house")) & (rate > 0)).alias("abroad"),
        (agreed & ~is_open & (F.coalesce("cash_disc_taken", F.lit(0)) == 0)
         & (F.col("clearing_date") > due)).alias("lost"),
        (agreed & is_open & (due < model.as_of)).alias("expired"),
        (agreed & is_open & (due >= model.as_of)).alias("running"),
        F.datediff("clearing_date", "baseline_date").alias("paid_after"),
    )
    lost, expired, running = F.col("lost"), F.col("expired"), F.col("running")
    discount = base * rate

    def percent(condition: Column) -> Column:
        return (_sum_if(discount, condition) * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)

    zero = F.lit(0).cast(MONEY)
    sums = marked.groupBy("bp_key", "company_code").agg(
        F.min(F.when(F.col("at_home"), F.col("currency"))).alias("currency"),
        F.count(F.when(F.col("at_home"), 1)).alias("invoices"),
        F.count(F.when(F.col("abroad"), 1)).alias("foreign_invoices"),
        F.count(F.when(lost, 1)).alias("late"),
        percent(lost).alias("loss"),
        _sum_if(base, lost).cast(MONEY).alias("discount_base"),
        F.count(F.when(expired, 1)).alias("n_expired"),
        F.coalesce(percent(expired), zero).alias("amount_expired"),
        F.count(F.when(running, 1)).alias("n_running"),
        F.coalesce(percent(running), zero).alias("amount_running"),
        F.max(F.when(lost, F.col("payment_terms"))).alias("terms_key"),
        F.max(F.when(lost, rate)).alias("rate"),
        F.max(F.when(lost, F.col("cash_disc_days1"))).alias("discount_days"),
        F.round(F.avg(F.when(lost, F.col("paid_after")))).cast("bigint").alias("mean_day"),
        F.min(F.when(lost, F.col("paid_after"))).alias("first_day"),
        F.max(F.when(lost, F.col("paid_after"))).alias("last_day"),
    )
    return sums.filter("invoices > 0")


def lost_discount(model: Model) -> DataFrame:
    """A vendor whose invoices were paid too late for the agreed discount, above a limit."""
    limit = F.lit(model.thresholds.get("min_loss", "1000.00")).cast(MONEY)
    found = (
        discount_buckets(model).filter(F.col("loss") >= limit)
        .join(model.partners("VENDOR", "role"), "bp_key")
        .join(terms_text(model["payment_terms"]), "terms_key", "left")
        .withColumn("terms", F.coalesce(
            "terms_text", F.concat(F.col("discount_days").cast("string"), F.lit(" Tage"))))
    )

    def money(name: str) -> Column:
        return numbers.money(F.col(name), F.col("currency"))

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    rate, as_of = numbers.trim_zeros(F.col("rate")), dates.iso_text(model.as_of)
    first_day = F.date_add(
        dates.months_back(model.as_of, model.thresholds.get("months", 12)), 1
    )
    one = F.col("n_running") == 1
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table="BSAK", source_field="SKNTO", current_value="0.00",
        current_display=F.concat(
            text("late"), F.lit(" von "), text("invoices"),
            F.lit(" Rechnungen nach Skontofrist bezahlt (Zahlungsbedingung "), "terms_key",
            F.lit(": "), "terms", F.lit(")")),
        proposed_display=F.concat(
            F.lit("Zahllauf-Timing für diesen Kreditor prüfen"),
            F.when(F.col("n_running") > 0, F.concat(
                F.lit("; noch vermeidbar: "), money("amount_running"), F.lit(" auf "),
                text("n_running"),
                F.when(one, F.lit(" offenen Rechnung")).otherwise(F.lit(" offenen Rechnungen")),
                F.lit(" mit laufender Skontofrist")))
            .otherwise(F.lit(
                "; der Verlust ist realisiert, an diesen Rechnungen ist nichts mehr zu holen"))),
        source_summary=F.concat(
            F.lit("Zahlungen im Mittel am Tag "), text("mean_day"),
            F.lit(" nach Skonto-Basisdatum, Skontofrist Tag "), text("discount_days")),
        evidence=F.array(
            evidence(
                "statistics",
                F.concat(F.lit("BSAK "), dates.iso_text(first_day), F.lit(".."), as_of),
                F.concat(text("late"), F.lit(" Rechnungen, Skontobasis "),
                         money("discount_base"), F.lit(", Skonto "), rate,
                         F.lit(" % nicht genutzt")),
                True,
                F.concat(F.lit("Zahlungen Tag "), text("first_day"), F.lit("–"),
                         text("last_day"), F.lit(" nach Skonto-Basisdatum"),
                         F.when(F.col("foreign_invoices") > 0, F.concat(
                             F.lit("; "), text("foreign_invoices"),
                             F.lit(" Rechnungen in Fremdwährung nicht mitgerechnet")))
                         .otherwise(F.lit(""))),
                kind="statement", observed_at=as_of),
            evidence("deterministic", F.concat(F.lit("T052 "), "terms_key"), F.col("terms"), True,
                     "Zahlungsbedingung laut LFB1"),
            evidence(
                "statistics", "BSIK (offene Posten)",
                F.concat(text("n_expired"),
                         F.lit(" offene Rechnungen mit abgelaufener Skontofrist ("),
                         money("amount_expired"), F.lit(" verfallen), "), text("n_running"),
                         F.lit(" mit laufender Frist ("), money("amount_running"),
                         F.lit(" vermeidbar)")),
                False, "Zu holen ist nur noch, was in der Frist liegt",
                kind="statement", observed_at=as_of)),
        impact_amount=F.col("loss"), impact_currency=F.col("currency"),
        impact_formula=F.concat(
            F.lit("Skontobasis "), money("discount_base"), F.lit(" × "), rate, F.lit(" % = "),
            money("loss"), F.lit(" (nur Rechnungen, die nach Skontofrist bezahlt wurden)")),
        params=params(loss=money("loss"), invoices=F.col("late")),
    )
