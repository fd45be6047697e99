"""Master data: placeholders, missing settings, blocks, accounts nobody uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model, contract, evidence, options, params
from ledgercheck.checks.vat import MASTER
from ledgercheck.functions import dates, numbers, text
from ledgercheck.operators.relevance import doc_types
from ledgercheck.schema import MONEY


def placeholder(model: Model) -> DataFrame:
    """A customer's name or city is a placeholder; the name counts first."""
    found = (
        model.partners("CUSTOMER", "role", "name1", "city")
        .withColumns({
            "in_name": text.has_placeholder(F.col("name1")),
            "in_city": text.has_placeholder(F.col("city")),
        })
        .filter(F.col("in_name") | F.col("in_city"))
        .withColumn("shown", F.when(F.col("in_name"), F.col("name1")).otherwise(F.col("city")))
        .withColumns({
            "word": text.placeholder_word(F.col("shown")),
            "field": F.when(F.col("in_name"), F.lit("NAME1")).otherwise(F.lit("ORT01")),
        })
    )
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table="KNA1",
        source_field=F.col("field"), current_value=F.col("shown"),
        current_display=F.concat(F.lit("Platzhalter „"), "word", F.lit('" als eigenes Wort')),
        evidence=F.array(evidence(
            "deterministic", "placeholder_terms", F.col("word"), False,
            "Treffer als ganzes Wort, Groß- und Kleinschreibung egal", kind="policy")),
        params=params(feld=F.col("field")),
    )


def terms_text(payment_terms: DataFrame) -> DataFrame:
    """One text per terms key: no or the lowest day limit, then the first text.

    Every place that shows a terms text uses this choice.
    """
    return payment_terms.groupBy("terms_key").agg(
        F.min(F.struct(
            F.coalesce("day_limit", F.lit(0)).alias("day_limit"),
            F.col("description").isNull().alias("no_text"), F.col("description"),
        )).alias("best")
    ).select("terms_key", F.col("best.description").alias("terms_text"))


def invoice_terms(model: Model) -> DataFrame:
    """Per customer and company code: invoices, kinds of terms, and the most frequent one.

    Counting per terms key first leaves a handful of rows per account, so the choice
    needs no window over single invoices.
    """
    per_terms = (
        model["fi_item"]
        .filter(F.col("doc_type").isin(*doc_types("AR", "invoice"))
                & F.col("payment_terms").isNotNull())
        .groupBy("bp_key", "company_code", "payment_terms").agg(F.count("*").alias("n"))
    )
    return per_terms.groupBy("bp_key", "company_code").agg(
        F.sum("n").alias("invoices"), F.count("*").alias("variants"),
        F.min(F.struct((-F.col("n")).alias("order"), F.col("payment_terms").alias("terms")))
        .alias("top"),
    ).select("bp_key", "company_code", "invoices", "variants",
             F.col("top.terms").alias("top_terms"), (-F.col("top.order")).alias("top_n"))


def terms_missing(model: Model) -> DataFrame:
    """A customer's company row has no payment terms; most invoices may show which.

    A majority is more than half of at least `min_invoices` invoices.
    """
    least = model.thresholds.get("min_invoices", 3)
    empty = (
        model["bp_company_code"].filter(F.col("payment_terms").isNull())
        .select("bp_key", "company_code")
        .join(model.partners("CUSTOMER", "role"), "bp_key")
    )
    found = (
        empty.join(invoice_terms(model), ["bp_key", "company_code"], "left")
        .fillna(0, ["invoices", "variants", "top_n"])
        .withColumn("majority", (F.col("top_n") * 2 > F.col("invoices"))
                    & (F.col("invoices") >= least))
        .join(terms_text(model["payment_terms"]).withColumnRenamed("terms_key", "top_terms"),
              "top_terms", "left")
    )
    majority = F.col("majority")
    n, top_n, kinds = (F.col(c).cast("string") for c in ("invoices", "top_n", "variants"))
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table="KNB1", source_field="ZTERM",
        current_display=F.when(majority, F.lit("nicht gepflegt"))
        .when(F.col("invoices") == 0,
              F.lit("nicht gepflegt; keine Rechnung im Buchungskreis"))
        .otherwise(F.concat(
            F.lit("nicht gepflegt; "), n, F.lit(" Rechnungen verteilen sich auf "), kinds,
            F.lit(" Zahlungsbedingungen ohne Mehrheit"))),
        proposed_value=F.when(majority, F.col("top_terms")),
        proposed_display=F.when(majority, F.col("terms_text")),
        source_summary=F.when(majority, F.concat(
            top_n, F.lit(" von "), n, F.lit(" Rechnungen im Buchungskreis tragen "), "top_terms")),
        tier=F.when(majority, F.lit("B")).otherwise(F.lit("C")),
        evidence=F.array(evidence(
            "invoice", F.concat(F.lit("Rechnungsbelege im Buchungskreis "), "company_code"),
            F.coalesce("top_terms", F.lit("–")), majority,
            F.concat(top_n, F.lit(" von "), n, F.lit(" Rechnungen; im Buchungskreis "),
                     F.when(F.col("variants") == 1, F.lit("nur diese eine Bedingung"))
                     .otherwise(F.concat(kinds, F.lit(" verschiedene Bedingungen")))),
            kind="document")),
        params=params(company_code=F.col("company_code")),
    )


def blocked_with_open_items(model: Model) -> DataFrame:
    """A deletion flag or block on a customer that still has open items."""
    house = model["company_code"].select("company_code", "currency")
    open_items = (
        model["fi_item"].filter("is_open").groupBy("bp_key", "company_code")
        .agg(F.sum("amount_signed_local").cast(MONEY).alias("open_local"))
        .filter("open_local <> 0").join(house, "company_code")
    )
    flags = model["bp_company_code"].select(
        "bp_key", "company_code", F.col("deletion_flag").alias("cc_deletion"), "posting_block"
    )
    found = (
        model.partners("CUSTOMER", "role", "deletion_flag", "central_block")
        .join(flags, "bp_key")
        .filter("deletion_flag OR central_block OR cc_deletion OR posting_block")
        .join(open_items, ["bp_key", "company_code"])
    )
    money = numbers.money(F.col("open_local"), F.col("currency"))
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table=F.expr("CASE WHEN deletion_flag OR central_block THEN 'KNA1' ELSE 'KNB1' END"),
        source_field=F.expr(
            "CASE WHEN deletion_flag OR (cc_deletion AND NOT central_block) THEN 'LOEVM' "
            "ELSE 'SPERR' END"),
        current_value="X",
        current_display=F.expr(
            "CASE WHEN deletion_flag OR cc_deletion THEN 'Löschvormerkung gesetzt' "
            "ELSE 'Buchungssperre gesetzt' END"),
        source_summary=F.concat(
            F.lit("Offene Posten "), money, F.lit(" bei gesetzter Sperre/Löschvormerkung")),
        options=options(
            ("Sperre/Löschvormerkung aufheben",
             "Konto wird wieder normal gemahnt und bebucht"),
            ("Posten ausgleichen/umbuchen, Kennzeichen beibehalten",
             "Konto bleibt gesperrt, offene Posten müssen manuell bereinigt werden")),
        evidence=F.array(evidence(
            "deterministic", F.concat(F.lit("BSID "), "company_code"), money, True,
            "Summe offene Posten im Buchungskreis")),
        impact_amount=F.col("open_local"), impact_currency=F.col("currency"),
        impact_formula=F.concat(F.lit("Summe offener Posten im Buchungskreis "), "company_code"),
        params=params(open_items=money, currency=F.col("currency")),
    )


_BUSINESS = {"CUSTOMER": "Kundenbeziehung", "VENDOR": "Lieferantenbeziehung"}


def unused_account(model: Model, role: str) -> DataFrame:
    """No item in the window, created before it (or nobody knows when), nothing open."""
    # one key per partner is enough for the anti join, and it is found on the map side
    posted = model["fi_item"].select("bp_key").distinct()
    relevance = model["bp_relevance"].filter("open_items_local = 0").select(
        "bp_key", "open_items_local", "currency"
    )
    created = F.col("created_on")
    found = (
        model.partners(role, "role", "created_on")
        .filter(created.isNull() | (created < model.window_from))
        .join(relevance, "bp_key").join(posted, "bp_key", "left_anti")
    )
    start = dates.date_text(model.window_from)
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table=MASTER[role],
        source_field="ERDAT", current_value=dates.iso_text(created),
        current_display="kein Posten im Postenfenster, keine offenen Posten",
        source_summary=F.concat(
            F.lit("Kein Posten seit Fensterbeginn "), start,
            F.lit("; Anlage davor; offene Posten "),
            numbers.money(F.col("open_items_local"), F.col("currency"))),
        options=options(
            ("Löschvormerkung setzen und archivieren",
             "Konto verschwindet aus Auswahllisten; Historie bleibt bis zum Archivlauf"),
            ("Konto behalten",
             f"Ruhende {_BUSINESS[role]} bleibt bebuchbar; Karteileiche bleibt in jeder "
             "Auswertung"),
            ("Nur Buchungssperre setzen",
             "Keine neuen Buchungen, Stammsatz bleibt für Auswertung und Historie erhalten")),
        evidence=F.array(evidence(
            "deterministic", "fi_item", "kein Posten im Postenfenster", True,
            "Letzte Aktivität: keine; Anlagedatum vor Fensterbeginn", kind="document")),
        params=params(window_from=start),
    )


def invoice_check_off(model: Model) -> DataFrame:
    """The double-invoice check is not set on a vendor's company row."""
    rows = model["bp_company_code"].select("bp_key", "company_code", "double_invoice_check").join(
        model.partners("VENDOR", "role"), "bp_key"
    )
    is_set = F.col("double_invoice_check").eqNullSafe(F.lit(True))
    support = rows.agg(
        F.count(F.when(is_set, 1)).alias("n_set"), F.count("*").alias("n_rows")
    ).select(F.struct(F.col("n_set").cast("string").alias("n_set"),
                     F.col("n_rows").cast("string").alias("n_rows")))
    found = rows.filter(~is_set).withColumn("support", support.scalar())
    n_set, n_rows = F.col("support.n_set"), F.col("support.n_rows")
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), company_code=F.col("company_code"),
        source_table="LFB1", source_field="REPRF", current_display="nicht gesetzt",
        proposed_value="X", proposed_display="Prüfung auf doppelte Rechnung einschalten",
        source_summary=F.concat(
            n_set, F.lit(" von "), n_rows,
            F.lit(" Kreditor-Buchungskreissätzen im Mandanten tragen das Kennzeichen bereits")),
        evidence=F.array(evidence(
            "deterministic", F.concat(F.lit("LFB1 "), "company_code"), "nicht gesetzt", False,
            F.concat(n_set, F.lit(" von "), n_rows,
                     F.lit(" Buchungskreissätzen tragen das Kennzeichen")),
            kind="master_field")),
        params=params(company_code=F.col("company_code")),
    )
