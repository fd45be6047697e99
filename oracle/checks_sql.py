"""DuckDB SQL of the checks, as flat rows."""

from __future__ import annotations

from oracle.model_sql import with_model

COLUMNS = (
    "bp_key", "role", "company_code", "source_table", "source_field", "current_value",
    "current_display", "proposed_value", "proposed_display", "source_summary", "tier",
    "impact_amount", "impact_currency", "impact_formula", "finding_key",
)


def money(amount: str, currency: str) -> str:
    """German money text."""
    return (
        f"(translate(format('{{:,.2f}}', {amount}), ',.', '.,') || ' ' || {currency})"
    )


def german(day: str) -> str:
    return f"strftime({day}, '%d.%m.%Y')"


def mask(iban: str) -> str:
    return f"(left({iban}, 4) || ' … ' || right({iban}, 4))"


def rows(source: str, **given: str) -> str:
    """SELECT of the contract columns, NULL for those not given."""
    kinds = {"impact_amount": "DECIMAL(15,2)"}
    picked = ", ".join(
        f"({given[c]})::{kinds.get(c, 'VARCHAR')} AS {c}" if c in given
        else f"NULL::{kinds.get(c, 'VARCHAR')} AS {c}" for c in COLUMNS
    )
    return f"SELECT {picked} FROM {source}"


_ROLE = {"AR": "CUSTOMER", "AP": "VENDOR"}
_MASTER = {"AR": "KNA1", "AP": "LFA1"}
_EU = "('AT','BE','BG','HR','CY','CZ','DK','EE','FI','FR','DE','GR','HU','IE','IT','LV','LT'," \
      "'LU','MT','NL','PL','PT','RO','SK','SI','ES','SE')"
_FORMS = {
    "AT": r"ATU\d{8}", "BE": r"BE[01]\d{9}", "CH": r"CHE\d{9}(MWST|TVA|IVA)?", "DE": r"DE\d{9}",
    "EL": r"EL\d{9}", "ES": r"ES[A-Z0-9]\d{7}[A-Z0-9]", "FR": r"FR[A-Z0-9]{2}\d{9}",
    "IT": r"IT\d{11}", "NL": r"NL\d{9}B\d{2}", "PL": r"PL\d{10}",
}


def _partners(side: str) -> str:
    return f"(SELECT * FROM business_partner WHERE role = '{_ROLE[side]}' AND NOT is_one_time)"


def vat_prefix(side: str) -> str:
    return rows(
        f"{_partners(side)} b JOIN bp_tax_id t USING (bp_key) WHERE tax_id_type = 'VAT' "
        f"AND country IN {_EU} AND regexp_full_match(left(value_norm, 2), '[A-Z]{{2}}') "
        "AND length(value_norm) >= 4 "
        "AND left(value_norm, 2) <> CASE country WHEN 'GR' THEN 'EL' ELSE country END",
        bp_key="bp_key", role="role", source_table=f"'{_MASTER[side]}'", source_field="'STCEG'",
        current_value="value",
        proposed_value="CASE country WHEN 'GR' THEN 'EL' ELSE country END || substr(value_norm, 3)",
        source_summary="'Sitzland ' || country || ' erwartet Präfix ' "
        "|| CASE country WHEN 'GR' THEN 'EL' ELSE country END || ' – ohne VIES-Bestätigung'",
    )


def vat_format(side: str) -> str:
    known = " OR ".join(f"regexp_full_match(value_norm, '{form}')" for form in _FORMS.values())
    lettered = "regexp_full_match(left(value_norm, 2), '[A-Z]{2}')"
    judged = ", ".join(f"'{p}'" for p in _FORMS)
    return rows(
        f"{_partners(side)} b JOIN bp_tax_id t USING (bp_key) WHERE tax_id_type = 'VAT' "
        f"AND NOT ({known}) AND (NOT {lettered} OR left(value_norm, 2) IN ({judged}))",
        bp_key="bp_key", role="role", source_table=f"'{_MASTER[side]}'", source_field="'STCEG'",
        current_value="value",
        current_display=f"CASE WHEN {lettered} THEN 'entspricht nicht dem Format für ' "
        "|| left(value_norm, 2) ELSE 'kein Länderpräfix – sieht wie eine Steuernummer aus' END",
    )


def invalid_iban(side: str) -> str:
    purpose = {"AR": ", die über diese IBAN per Lastschrift eingezogen würden",
               "AP": ", die an diese IBAN gezahlt würden"}[side]
    return rows(
        f"{_partners(side)} b JOIN bp_bank_account a USING (bp_key) "
        "JOIN bp_relevance r USING (bp_key) WHERE NOT iban_valid",
        bp_key="bp_key", role="role", source_table="'TIBAN'", source_field="'IBAN'",
        current_value=mask("iban_norm"), current_display="'Prüfziffer ungültig (Mod-97)'",
        impact_amount="CASE WHEN open_items_local > 0 THEN open_items_local END",
        impact_currency="CASE WHEN open_items_local > 0 THEN currency END",
        impact_formula="CASE WHEN open_items_local > 0 THEN 'Offene Posten ' || "
        + money("open_items_local", "currency") + f" || '{purpose}' END",
    )


def unused_account(side: str) -> str:
    return rows(
        f"{_partners(side)} b JOIN bp_relevance r USING (bp_key) CROSS JOIN delivered "
        "WHERE bp_key NOT IN (SELECT bp_key FROM fi_item) AND open_items_local = 0 "
        "AND coalesce(created_on < window_from, TRUE)",
        bp_key="bp_key", role="role", source_table=f"'{_MASTER[side]}'", source_field="'ERDAT'",
        current_value="created_on",
        current_display="'kein Posten im Postenfenster, keine offenen Posten'",
        source_summary="'Kein Posten seit Fensterbeginn ' || " + german("window_from")
        + " || '; Anlage davor; offene Posten ' || " + money("open_items_local", "currency"),
    )


# the words the derived names and cities contain; the list itself is tested on fixtures
_WORD = "(^|[^a-z0-9äöüß])(test|unbekannt|muster)([^a-z0-9äöüß]|$)"
PLACEHOLDER = rows(
    "(SELECT *, regexp_extract(lower(name1), '" + _WORD + "', 2) AS in_name, "
    "regexp_extract(lower(city), '" + _WORD + "', 2) AS in_city FROM "
    + _partners("AR") + ") WHERE in_name <> '' OR in_city <> ''",
    bp_key="bp_key", role="role", source_table="'KNA1'",
    source_field="CASE WHEN in_name <> '' THEN 'NAME1' ELSE 'ORT01' END",
    current_value="CASE WHEN in_name <> '' THEN name1 ELSE city END",
    current_display="'Platzhalter „' || CASE WHEN in_name <> '' THEN in_name ELSE in_city END "
    "|| '\" als eigenes Wort'",
)

_TERMS_TEXT = (
    "(SELECT terms_key, arg_min(description, coalesce(day_limit, 0)) AS terms_text "
    "FROM payment_terms GROUP BY terms_key)"
)
TERMS_MISSING = rows(
    "(SELECT bp_key, company_code, role FROM bp_company_code JOIN " + _partners("AR")
    + " USING (bp_key) WHERE payment_terms IS NULL) e "
    "LEFT JOIN (SELECT bp_key, company_code, sum(c) AS n, count(*) AS kinds, max(c) AS top_n, "
    "arg_min(t, (-c, t)) AS top FROM (SELECT bp_key, company_code, payment_terms AS t, "
    "count(*) AS c FROM fi_item WHERE doc_type = 'DR' AND payment_terms IS NOT NULL "
    "GROUP BY ALL) GROUP BY ALL) i USING (bp_key, company_code) "
    f"LEFT JOIN {_TERMS_TEXT} x ON x.terms_key = i.top "
    "CROSS JOIN LATERAL (SELECT coalesce(top_n * 2 > n AND n >= 3, FALSE) AS major)",
    bp_key="bp_key", role="role", company_code="company_code", source_table="'KNB1'",
    source_field="'ZTERM'",
    current_display="CASE WHEN major THEN 'nicht gepflegt' WHEN n IS NULL "
    "THEN 'nicht gepflegt; keine Rechnung im Buchungskreis' ELSE 'nicht gepflegt; ' || n "
    "|| ' Rechnungen verteilen sich auf ' || kinds || ' Zahlungsbedingungen ohne Mehrheit' END",
    proposed_value="CASE WHEN major THEN top END",
    proposed_display="CASE WHEN major THEN terms_text END",
    source_summary="CASE WHEN major THEN top_n || ' von ' || n "
    "|| ' Rechnungen im Buchungskreis tragen ' || top END",
    tier="CASE WHEN major THEN 'B' ELSE 'C' END",
)

BLOCKED = rows(
    _partners("AR") + " b JOIN (SELECT bp_key, company_code, posting_block, "
    "deletion_flag AS cc_del FROM bp_company_code) c USING (bp_key) "
    "JOIN (SELECT bp_key, company_code, sum(amount_signed_local) AS total FROM fi_item "
    "WHERE is_open GROUP BY ALL) o USING (bp_key, company_code) "
    "WHERE (deletion_flag OR central_block OR cc_del OR posting_block) AND total <> 0",
    bp_key="bp_key", role="role", company_code="company_code",
    source_table="CASE WHEN deletion_flag OR central_block THEN 'KNA1' ELSE 'KNB1' END",
    source_field="CASE WHEN deletion_flag THEN 'LOEVM' WHEN central_block THEN 'SPERR' "
    "WHEN cc_del THEN 'LOEVM' ELSE 'SPERR' END",
    current_value="'X'",
    current_display="CASE WHEN deletion_flag OR cc_del THEN 'Löschvormerkung gesetzt' "
    "ELSE 'Buchungssperre gesetzt' END",
    source_summary="'Offene Posten ' || " + money("total", "'EUR'")
    + " || ' bei gesetzter Sperre/Löschvormerkung'",
    impact_amount="total", impact_currency="'EUR'",
    impact_formula="'Summe offener Posten im Buchungskreis ' || company_code",
)

CHECK_OFF = rows(
    "bp_company_code c JOIN " + _partners("AP") + " b USING (bp_key), "
    "(SELECT count(*) AS n, count(*) FILTER (double_invoice_check) AS n_set "
    "FROM bp_company_code JOIN " + _partners("AP") + " USING (bp_key)) "
    "WHERE c.double_invoice_check IS NOT TRUE",
    bp_key="bp_key", role="role", company_code="company_code", source_table="'LFB1'",
    source_field="'REPRF'", current_display="'nicht gesetzt'", proposed_value="'X'",
    proposed_display="'Prüfung auf doppelte Rechnung einschalten'",
    source_summary="n_set || ' von ' || n "
    "|| ' Kreditor-Buchungskreissätzen im Mandanten tragen das Kennzeichen bereits'",
)

UNAPPLIED = rows(
    "(SELECT *, date_diff('day', posting_date, as_of) AS days FROM fi_item, run "
    "WHERE doc_type = 'DZ' AND debit_credit = 'H' AND is_open AND special_gl IS NULL "
    "AND reference_norm IS NULL AND clearing_date IS NULL) p "
    "SEMI JOIN (SELECT bp_key FROM business_partner WHERE role = 'CUSTOMER') b "
    "ON b.bp_key = p.bp_key "
    "LEFT JOIN (SELECT bp_key, company_code, count(*) AS n, sum(amount_doc) AS total "
    "FROM fi_item WHERE doc_type = 'DR' AND debit_credit = 'S' AND is_open GROUP BY ALL) o "
    "ON o.bp_key = p.bp_key AND o.company_code = p.company_code WHERE days > 30",
    bp_key="p.bp_key", role="'CUSTOMER'", company_code="p.company_code",
    source_table="'BSID'", source_field="'XBLNR'",
    current_display="'Zahlungseingang über ' || " + money("amount_doc", "currency")
    + " || ' vom ' || " + german("posting_date")
    + " || ', seit ' || days || ' Tagen ohne Rechnungsbezug und ohne Ausgleich'",
    proposed_display="CASE WHEN n > 0 THEN 'Zahlung einer offenen Rechnung zuordnen (F-32)' "
    "ELSE 'Keine offene Rechnung auf dem Konto – Rückzahlung veranlassen' END",
    source_summary="'Beleg ' || document_no "
    "|| ': XBLNR, ZUONR und REBZG leer, kein Ausgleichsbeleg, ' || days || ' Tage alt; ' "
    "|| CASE WHEN n IS NULL THEN 'keine offene Rechnung im Buchungskreis' "
    "WHEN n = 1 THEN 'eine offene Rechnung über ' || " + money("total", "'EUR'")
    + " ELSE n || ' offene Rechnungen über ' || " + money("total", "'EUR'") + " END",
    finding_key="document_no",
)

_PAID = (
    "(SELECT * FROM fi_item WHERE doc_type IN ('KR', 'RE') AND debit_credit = 'H' "
    "AND NOT is_open AND reference_norm IS NOT NULL "
    "AND bp_key IN (SELECT bp_key FROM business_partner WHERE role = 'VENDOR'))"
)
# the later invoice of a pair with its nearest earlier match, a before b by item key
NEAREST = f"""
paid AS {_PAID},
near AS (
    SELECT l.item_key AS l_key, e.item_key AS e_key,
           date_diff('day', e.document_date, l.document_date) AS gap,
           count(*) OVER (PARTITION BY l.item_key) AS matches
    FROM paid l JOIN paid e ON e.bp_key = l.bp_key AND e.currency = l.currency
     AND e.amount_doc = l.amount_doc AND e.item_key <> l.item_key
     AND date_diff('day', e.document_date, l.document_date) BETWEEN 0 AND 60
     AND levenshtein(e.reference_norm, l.reference_norm) <= 1
    WHERE NOT EXISTS (SELECT 1 FROM fi_item g WHERE g.doc_type = 'KG' AND g.debit_credit = 'S'
        AND g.bp_key = l.bp_key AND g.currency = l.currency AND g.amount_doc = l.amount_doc
        AND g.document_date BETWEEN l.document_date AND l.document_date + 180)),
nearest AS (
    SELECT least(l_key, e_key) AS a_key, greatest(l_key, e_key) AS b_key, matches
    FROM near WHERE gap > 0 OR e_key < l_key
    QUALIFY row_number() OVER (PARTITION BY l_key ORDER BY gap, e_key) = 1)"""
DOUBLE = rows(
    "nearest JOIN paid a ON a.item_key = a_key JOIN paid b ON b.item_key = b_key",
    bp_key="a.bp_key", role="'VENDOR'", company_code="a.company_code", source_table="'BSAK'",
    source_field="'XBLNR'", current_value="a.reference || ' | ' || b.reference",
    current_display="'Zwei bezahlte Rechnungen über ' || " + money("a.amount_doc", "a.currency"),
    proposed_display="'Rückforderung oder Verrechnung'",
    source_summary="'Belegpaar ' || a.document_no || ' / ' || b.document_no "
    "|| ': gleicher Betrag, Referenz ' || CASE WHEN a.reference = b.reference THEN 'identisch' "
    "ELSE 'nahezu identisch' END || ', ' "
    "|| abs(date_diff('day', a.document_date, b.document_date)) "
    "|| ' Tage Abstand, keine Gutschrift in 180 Tagen' "
    "|| CASE WHEN matches > 1 THEN '; ' || matches || ' passende Belege' ELSE '' END",
    impact_amount="a.amount_doc", impact_currency="a.currency",
    impact_formula="'Betrag der zweiten Zahlung, keine Gutschrift gefunden'",
    finding_key="a.document_no || '|' || b.document_no",
)

DISCOUNT_BUCKETS = """
discount_rows AS (
    SELECT i.*, as_of, currency = 'EUR' AS home, baseline_date + cash_disc_days1 AS due,
           date_diff('day', baseline_date, clearing_date) AS paid_after
    FROM fi_item i, window_days
    WHERE doc_type IN ('KR', 'RE') AND posting_date > since AND posting_date <= as_of
),
discount_marked AS (
    SELECT *, home AND cash_disc_pct1 > 0 AND due IS NOT NULL AS agreed FROM discount_rows
),
buckets AS (
    SELECT bp_key, company_code, count(*) FILTER (home) AS n,
           count(*) FILTER (NOT home AND cash_disc_pct1 > 0) AS abroad,
           count(*) FILTER (lost) AS late,
           sum(cash_disc_base * cash_disc_pct1) FILTER (lost) AS lost_sum,
           sum(cash_disc_base) FILTER (lost) AS base,
           count(*) FILTER (agreed AND is_open AND due < as_of) AS n_expired,
           sum(cash_disc_base * cash_disc_pct1) FILTER (agreed AND is_open AND due < as_of)
               AS expired_sum,
           count(*) FILTER (agreed AND is_open AND due >= as_of) AS n_running,
           sum(cash_disc_base * cash_disc_pct1) FILTER (agreed AND is_open AND due >= as_of)
               AS running_sum,
           max(payment_terms) FILTER (lost) AS terms_key, max(cash_disc_pct1) FILTER (lost) AS rate,
           max(cash_disc_days1) FILTER (lost) AS days,
           round(avg(paid_after) FILTER (lost))::BIGINT AS mean_day,
           min(paid_after) FILTER (lost) AS first_day, max(paid_after) FILTER (lost) AS last_day
    FROM (SELECT *, agreed AND NOT is_open AND cash_disc_taken = 0 AND clearing_date > due AS lost
          FROM discount_marked)
    GROUP BY ALL
    HAVING count(*) FILTER (home) > 0
),
discount AS (
    SELECT *, (lost_sum * 0.01)::DECIMAL(15,2) AS loss,
           coalesce((expired_sum * 0.01)::DECIMAL(15,2), 0) AS expired,
           coalesce((running_sum * 0.01)::DECIMAL(15,2), 0) AS running
    FROM buckets
)"""
LOST_DISCOUNT = rows(
    "discount d JOIN " + _partners("AP") + f" b USING (bp_key) JOIN {_TERMS_TEXT} t "
    "USING (terms_key) WHERE loss >= 1000",
    bp_key="bp_key", role="role", company_code="company_code", source_table="'BSAK'",
    source_field="'SKNTO'", current_value="'0.00'",
    current_display="late || ' von ' || n || ' Rechnungen nach Skontofrist bezahlt "
    "(Zahlungsbedingung ' || terms_key || ': ' || terms_text || ')'",
    proposed_display="'Zahllauf-Timing für diesen Kreditor prüfen' || CASE WHEN n_running > 0 "
    "THEN '; noch vermeidbar: ' || " + money("running", "'EUR'") + " || ' auf ' || n_running "
    "|| CASE WHEN n_running = 1 THEN ' offenen Rechnung' ELSE ' offenen Rechnungen' END "
    "|| ' mit laufender Skontofrist' ELSE "
    "'; der Verlust ist realisiert, an diesen Rechnungen ist nichts mehr zu holen' END",
    source_summary="'Zahlungen im Mittel am Tag ' || mean_day "
    "|| ' nach Skonto-Basisdatum, Skontofrist Tag ' || days",
    impact_amount="loss", impact_currency="'EUR'",
    impact_formula="'Skontobasis ' || " + money("base", "'EUR'") + " || ' × 2 % = ' || "
    + money("loss", "'EUR'") + " || ' (nur Rechnungen, die nach Skontofrist bezahlt wurden)'",
)

CLUSTERS = """
vendor_ibans AS (
    SELECT DISTINCT iban_norm, bp_key
    FROM bp_bank_account
    WHERE bp_key IN (SELECT bp_key FROM business_partner
                     WHERE role = 'VENDOR' AND NOT is_one_time)
),
links AS (
    SELECT bp_key, alt_payer_key AS other FROM business_partner
    UNION SELECT bp_key, alt_payer_key FROM bp_company_code
    UNION SELECT 'C:' || lpad(k::VARCHAR, 10, '0'),
                 'C:' || lpad((CASE WHEN k % 13 = 4 THEN k - 1 ELSE k END)::VARCHAR, 10, '0')
          FROM business_partner WHERE role = 'CUSTOMER'
),
clusters AS (
    SELECT iban_norm, min(bp_key) AS anchor, count(*) AS accounts,
           string_agg(bp_key, ',' ORDER BY bp_key) AS members
    FROM vendor_ibans v
    GROUP BY iban_norm
    HAVING count(*) > 1 AND NOT EXISTS (
        SELECT 1 FROM links l JOIN vendor_ibans x ON x.bp_key = l.bp_key
        JOIN vendor_ibans y ON y.bp_key = l.other AND y.iban_norm = x.iban_norm
        WHERE x.iban_norm = v.iban_norm AND l.bp_key <> l.other)
)"""
SHARED_IBAN = rows(
    "clusters", bp_key="anchor", role="'VENDOR'", source_table="'TIBAN'", source_field="'IBAN'",
    current_value=mask("iban_norm"),
    current_display="'bei ' || accounts "
    "|| ' Kreditorenkonten hinterlegt, ohne Regulierer-Bezug'",
)

MATCHES = """
account_values AS (
    SELECT bp_key, role, 'USt-IdNr.' AS criterion, value_norm AS value, value_norm AS shown
    FROM bp_tax_id JOIN business_partner USING (bp_key)
    WHERE tax_id_type = 'VAT' AND NOT is_one_time
    UNION
    SELECT bp_key, role, 'Bankverbindung', iban_norm, left(iban_norm, 4) || ' … '
           || right(iban_norm, 4)
    FROM bp_bank_account JOIN business_partner USING (bp_key) WHERE NOT is_one_time
),
matches AS (
    SELECT c.bp_key AS customer, v.bp_key AS vendor, criterion, c.shown
    FROM account_values c JOIN account_values v USING (criterion, value)
    WHERE c.role = 'CUSTOMER' AND v.role = 'VENDOR'
),
match_groups AS (
    SELECT customer, string_agg(DISTINCT criterion, ' und ' ORDER BY criterion) AS criteria,
           string_agg(DISTINCT CASE criterion WHEN 'Bankverbindung' THEN 'IBAN' ELSE 'STCEG' END,
                      ' + ' ORDER BY CASE criterion WHEN 'Bankverbindung' THEN 'IBAN'
                                     ELSE 'STCEG' END) AS fields,
           string_agg(DISTINCT shown, ' / ' ORDER BY shown) AS shown,
           string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors,
           count(DISTINCT vendor) AS n
    FROM matches GROUP BY customer
)"""
CROSS = rows(
    "match_groups", bp_key="customer", role="'CUSTOMER'", source_table="'KNA1 + LFA1'",
    source_field="fields", current_value="shown",
    current_display="'derselbe Geschäftspartner ist als Debitor und als Kreditor geführt "
    "(Übereinstimmung: ' || criteria || ')'",
    proposed_display="'Verrechnung prüfen und beide Konten gegenseitig eintragen – "
    "nicht zusammenführen'",
    source_summary="'Deterministischer Abgleich: ' || criteria || ' identisch bei Debitor und ' "
    "|| CASE WHEN n = 1 THEN 'einem Kreditorenkonto' ELSE n || ' Kreditorenkonten' END "
    "|| '; kein Namens- oder Adressabgleich'",
)

# rule id -> (SELECT, further WITH entries)
RULE_SQL: dict[str, tuple[str, str]] = {
    "AR-VAL-001": (vat_prefix("AR"), ""), "AP-VAL-001": (vat_prefix("AP"), ""),
    "AR-VAL-002": (vat_format("AR"), ""), "AP-VAL-002": (vat_format("AP"), ""),
    "AR-VAL-003": (invalid_iban("AR"), ""), "AP-VAL-003": (invalid_iban("AP"), ""),
    "AR-HYG-001": (unused_account("AR"), ""), "AP-HYG-001": (unused_account("AP"), ""),
    "AR-VAL-005": (PLACEHOLDER, ""), "AR-COM-002": (TERMS_MISSING, ""),
    "AR-CON-002": (BLOCKED, ""), "AP-COM-003": (CHECK_OFF, ""), "AR-LEA-001": (UNAPPLIED, ""),
    "AP-LEA-001": (DOUBLE, NEAREST), "AP-LEA-002": (LOST_DISCOUNT, DISCOUNT_BUCKETS),
    "AP-CON-001": (SHARED_IBAN, CLUSTERS), "CROSS-DUP-001": (CROSS, MATCHES),
}


def rule_sql(rule_id: str) -> str:
    select, ctes = RULE_SQL[rule_id]
    return with_model(select, "relevance", ctes)


# damage class, category, severity, default tier and action type per rule
RULE_CLASS = {
    "VAL-001": (2, "validity", "high", "B", "review"),
    "VAL-002": (2, "validity", "high", "C", "review"),
    "VAL-003": (1, "validity", "critical", "C", "review"),
    "HYG-001": (3, "hygiene", "low", "decision", "decision"),
    "AR-VAL-005": (3, "validity", "medium", "C", "review"),
    "AR-COM-002": (2, "completeness", "medium", "C", "review"),
    "AR-CON-002": (3, "consistency", "high", "decision", "decision"),
    "AP-COM-003": (3, "completeness", "high", "A", "mass_change"),
    "AR-LEA-001": (3, "leakage", "medium", "B", "review"),
    "AP-LEA-001": (2, "leakage", "critical", "B", "review"),
    "AP-LEA-002": (3, "leakage", "medium", "C", "process"),
    "AP-CON-001": (1, "consistency", "critical", "C", "review"),
    "CROSS-DUP-001": (2, "duplicate", "medium", "B", "review"),
}


def findings_ctes() -> str:
    """All checks as one table `findings` with ids, classes and names."""
    parts = []
    for rule_id, (select, _) in sorted(RULE_SQL.items()):
        key = rule_id if rule_id in RULE_CLASS else rule_id.split("-", 1)[1]
        damage, category, severity, tier, action = RULE_CLASS[key]
        parts.append(
            f"SELECT '{rule_id}' AS rule_id, '{rule_id.split('-')[0]}' AS side, "
            f"{damage} AS damage_class, '{category}' AS category, '{severity}' AS severity, "
            f"'{tier}' AS default_tier, '{action}' AS action_type, r.* FROM ({select}) r"
        )
    union = "\nUNION ALL\n".join(parts)
    return ",".join([DISCOUNT_BUCKETS, CLUSTERS, MATCHES, NEAREST]) + f""",
all_rows AS ({union}),
findings AS (
    SELECT 'F-' || substr(sha1(concat_ws('|', rule_id, a.bp_key, coalesce(company_code, ''),
               source_table, source_field, coalesce(current_value, ''),
               coalesce(finding_key, ''))), 1, 12) AS finding_id,
           a.* EXCLUDE (tier, default_tier), coalesce(tier, default_tier) AS tier,
           name1 || ', ' || city AS display_name
    FROM all_rows a JOIN (SELECT bp_key, name1, city FROM business_partner) b USING (bp_key)
)"""


def with_findings(body: str, ctes: str = "") -> str:
    extra = findings_ctes() + ("," + ctes if ctes else "")
    return with_model(body, "relevance", extra)
