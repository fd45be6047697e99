"""DuckDB SQL of the catalogue checks beside the client's 17, over the client with gaps."""

from __future__ import annotations

from oracle.checks_sql import _EU, _MASTER, _ROLE, german, mask, rows
from oracle.model_sql import with_model

_GAPS = """
gap_tax AS (
  SELECT bp_key FROM bp_tax_id
  WHERE tax_id_type = 'VAT' AND substr(bp_key, 3)::BIGINT % 17 <> 0),
gap_company AS (
  SELECT bp_key, company_code, posting_block, deletion_flag AS row_deletion,
         CASE substr(bp_key, 3)::BIGINT % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'T' WHEN 2 THEN 'L' END
           AS payment_methods,
         substr(bp_key, 3)::BIGINT % 9 = 2 AS no_dunning,
         CASE WHEN bp_key LIKE 'C:%' AND substr(bp_key, 3)::BIGINT % 7 = 0 THEN 'ZB09'
              ELSE payment_terms END AS master_terms
  FROM bp_company_code),
gap_bank AS (
  SELECT bp_key, bank_key, account_number,
         CASE WHEN bp_key LIKE 'C:%' AND substr(bp_key, 3)::BIGINT % 20 IN (6, 16)
              THEN 'AT' || lpad((substr(bp_key, 3)::BIGINT // 40)::VARCHAR, 18, '0')
              ELSE iban_norm END AS iban_norm
  FROM bp_bank_account WHERE substr(bp_key, 3)::BIGINT % 13 <> 0),
customer_links AS (
  SELECT bp_key, alt_payer_key AS other FROM business_partner
  UNION SELECT bp_key, alt_payer_key FROM bp_company_code
  UNION SELECT bp_key, 'C:' || lpad((CASE WHEN k % 13 = 4 THEN k - 1 ELSE k END)::VARCHAR, 10, '0')
        FROM business_partner WHERE role = 'CUSTOMER'),
shared AS (
  SELECT iban_norm, min(bp_key) AS anchor, count(DISTINCT bp_key) AS accounts
  FROM gap_bank g SEMI JOIN (SELECT * FROM business_partner
                             WHERE role = 'CUSTOMER' AND NOT is_one_time) USING (bp_key)
  GROUP BY iban_norm HAVING count(DISTINCT bp_key) > 1),
apart AS (
  SELECT * FROM shared s WHERE NOT EXISTS (
    SELECT 1 FROM customer_links l JOIN gap_bank x USING (bp_key) JOIN gap_bank y
      ON y.bp_key = l.other AND y.iban_norm = x.iban_norm
    WHERE x.iban_norm = s.iban_norm AND l.bp_key <> l.other
      AND l.bp_key IN (SELECT bp_key FROM business_partner WHERE NOT is_one_time)
      AND l.other IN (SELECT bp_key FROM business_partner WHERE NOT is_one_time))),
used AS (
  SELECT i.bp_key, i.company_code, master_terms, i.payment_terms AS terms, count(*) AS n
  FROM fi_item i JOIN gap_company c USING (bp_key, company_code)
  WHERE doc_type = 'DR' AND i.payment_terms IS NOT NULL AND master_terms IS NOT NULL GROUP BY ALL),
deviating AS (
  SELECT bp_key, company_code, master_terms, sum(n)::BIGINT AS invoices,
         coalesce(sum(n) FILTER (terms <> master_terms), 0)::BIGINT AS other,
         arg_min(terms, (-n, terms)) AS top, max(n) AS top_n
  FROM used GROUP BY ALL
  HAVING sum(n) >= 3 AND coalesce(sum(n) FILTER (terms <> master_terms), 0) * 10 > sum(n) * 7),
lowest AS (
  SELECT terms_key, arg_min(days1, day_limit) AS days FROM payment_terms GROUP BY terms_key),
late AS (
  SELECT bp_key, company_code, count(*) AS n,
         sum(round(amount_local * 0.02, 2))::DECIMAL(15,2) AS late
  FROM fi_item JOIN lowest ON terms_key = payment_terms
  WHERE doc_type = 'DR' AND NOT is_open AND document_no::BIGINT % 7 = 0 AND currency = 'EUR'
    AND round(amount_local * 0.02, 2) > 0 AND clearing_date > baseline_date + days GROUP BY ALL),
paid AS (
  SELECT bp_key, company_code, count(*) AS n, sum(amount_local)::DECIMAL(15,2) AS paid
  FROM fi_item, window_days
  WHERE doc_type = 'KZ' AND posting_date > since AND posting_date <= as_of GROUP BY ALL)"""

_POSTAL = {"DE": r"\d{5}", "AT": r"\d{4}", "FR": r"\d{5}", "IT": r"\d{5}",
           "NL": r"\d{4}\s?[A-Z]{2}", "PL": r"\d{2}-\d{3}", "GR": r"\d{3}\s?\d{2}",
           "BE": r"\d{4}", "ES": r"\d{5}", "CH": r"\d{4}"}
_COMPANY = {"AR": "KNB1", "AP": "LFB1"}


def _partners(side: str) -> str:
    return (f"(SELECT * FROM business_partner WHERE role = '{_ROLE[side]}' "
            "AND NOT is_one_time) b")


def _sql(source: str, **given: str) -> str:
    return with_model(rows(source, **given), "relevance", _GAPS)


def _vat_missing(side: str) -> str:
    return _sql(
        f"{_partners(side)} ANTI JOIN gap_tax USING (bp_key) "
        f"WHERE country IN {_EU} AND country <> 'DE'",
        bp_key="bp_key", role="role", source_table=f"'{_MASTER[side]}'", source_field="'STCEG'",
        current_display="'USt-ID nicht gepflegt, Sitzland ' || country")


def _bank_missing(side: str, letters: str) -> str:
    return _sql(
        f"{_partners(side)} JOIN gap_company USING (bp_key) ANTI JOIN gap_bank USING (bp_key) "
        f"WHERE regexp_matches(payment_methods, '[{letters}]')",
        bp_key="bp_key", role="role", company_code="company_code",
        source_table=f"'{_COMPANY[side]}'", source_field="'ZWELS'",
        current_value="payment_methods",
        current_display="'Zahlweg ' || payment_methods || ' ohne Bankverbindung'")


def _bank_abroad(side: str) -> str:
    return _sql(
        f"{_partners(side)} JOIN gap_bank USING (bp_key) WHERE left(iban_norm, 2) <> country",
        bp_key="bp_key", role="role", source_table="'TIBAN'", source_field="'IBAN'",
        current_value=mask("iban_norm"),
        current_display="'IBAN aus ' || left(iban_norm, 2) || ', Sitz in ' || country",
        finding_key="bank_key || '|' || account_number")


_FORM = " ".join(f"WHEN '{c}' THEN regexp_full_match(trim(postal_code), '{p}')"
                 for c, p in _POSTAL.items())

CATALOGUE_ORACLE = {
    "check_ar_com_001": _vat_missing("AR"), "check_ap_com_001": _vat_missing("AP"),
    "check_ar_com_003": _bank_missing("AR", "EL"), "check_ap_com_002": _bank_missing("AP", "TU"),
    "check_ar_com_004": _sql(
        f"{_partners('AR')} JOIN gap_company USING (bp_key) JOIN bp_relevance USING (bp_key) "
        "WHERE no_dunning AND activity_status = 'active'",
        bp_key="bp_key", role="role", company_code="company_code", source_table="'KNB5'",
        source_field="'MAHNA'", current_display="'Mahnverfahren nicht gepflegt'",
        proposed_value="'0001'", proposed_display="'Standardverfahren 0001 eintragen'",
        tier="'A'"),
    "check_ar_val_004": _sql(
        f"{_partners('AR')} WHERE trim(postal_code) <> '' AND NOT CASE country {_FORM} END",
        bp_key="bp_key", role="role", source_table="'KNA1'", source_field="'PSTLZ'",
        current_value="postal_code",
        current_display="'entspricht nicht dem Format für ' || country"),
    "check_ar_con_001": _sql(
        f"{_partners('AR')} JOIN deviating USING (bp_key)",
        bp_key="bp_key", role="role", company_code="company_code", source_table="'KNB1'",
        source_field="'ZTERM'", current_value="master_terms",
        current_display="other || ' von ' || invoices "
                        "|| ' Rechnungen mit anderer Zahlungsbedingung'",
        proposed_value="top",
        source_summary="top_n || ' von ' || invoices || ' Rechnungen tragen ' || top"),
    "check_ar_con_003": _bank_abroad("AR"), "check_ap_con_002": _bank_abroad("AP"),
    "check_ar_con_004": _sql(
        "apart", bp_key="anchor", role="'CUSTOMER'", source_table="'TIBAN'",
        source_field="'IBAN'", current_value=mask("iban_norm"),
        current_display="'bei ' || accounts "
                        "|| ' Debitorenkonten hinterlegt, ohne Regulierer-Bezug'"),
    "check_ar_hyg_002": _sql(
        f"{_partners('AR')} CROSS JOIN delivered CROSS JOIN window_days "
        "WHERE created_on >= window_from AND created_on < since "
        "AND bp_key NOT IN (SELECT bp_key FROM fi_item)",
        bp_key="bp_key", role="role", source_table="'KNA1'", source_field="'ERDAT'",
        current_value="created_on",
        current_display="'seit Anlage am ' || " + german("created_on") + " || ' ohne Posten'"),
    "check_ar_lea_003": _sql(
        f"{_partners('AR')} JOIN late USING (bp_key)",
        bp_key="bp_key", role="role", company_code="company_code", source_table="'BSAD'",
        source_field="'SKNTO'", current_value="late",
        current_display="'Skonto nach Fristablauf auf ' || n || ' Rechnungen'",
        impact_amount="late", impact_currency="'EUR'",
        impact_formula="'Summe der nach Fristablauf gewährten Skonti'"),
    "check_ap_con_003": _sql(
        f"{_partners('AP')} JOIN paid USING (bp_key) "
        "LEFT JOIN gap_company USING (bp_key, company_code) "
        "WHERE deletion_flag OR central_block OR coalesce(row_deletion, FALSE) "
        "OR coalesce(posting_block, FALSE)",
        bp_key="bp_key", role="role", company_code="company_code",
        source_table="CASE WHEN deletion_flag OR central_block THEN 'LFA1' ELSE 'LFB1' END",
        source_field="CASE WHEN deletion_flag OR (coalesce(row_deletion, FALSE) "
                     "AND NOT central_block) THEN 'LOEVM' ELSE 'SPERR' END",
        current_value="'X'",
        current_display="n || ' Zahlungen an ein gesperrtes oder zur Löschung vorgemerktes Konto'",
        impact_amount="paid", impact_currency="'EUR'",
        impact_formula="'Summe der Zahlungen der letzten 12 Monate'"),
}
