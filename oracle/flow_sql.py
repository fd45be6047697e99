"""DuckDB SQL of the checks of money flows."""

from __future__ import annotations

from oracle.checks_sql import money, rows
from oracle.model_sql import with_model

_CHANGES = """
change_document AS (
  SELECT 'V:' || lpad((CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_custkey % 97 END)::VARCHAR, 10, '0')
           AS bp_key, lpad(o_orderkey::VARCHAR, 10, '0') AS change_no,
         o_orderdate::DATE AS changed_on, 'U' || (o_custkey % 7) AS changed_by
  FROM orders WHERE o_orderkey % 9 < 3),
payment_changes AS (
  SELECT p.bp_key, item_key, company_code, posting_date AS day, amount_local,
         posting_date - changed_on AS days, change_no, changed_on, changed_by
  FROM fi_item p JOIN change_document c
    ON c.bp_key = p.bp_key AND c.changed_on <= p.posting_date AND p.doc_type = 'KZ'
  QUALIFY row_number() OVER (PARTITION BY item_key
                             ORDER BY changed_on DESC, change_no DESC, changed_by DESC) = 1),
soon AS (SELECT * REPLACE (days::INTEGER AS days) FROM payment_changes WHERE days < 30),
vendors AS (SELECT bp_key FROM business_partner WHERE role = 'VENDOR' AND NOT is_one_time),
per_change AS (
  SELECT s.bp_key, change_no, count(*) AS n, sum(amount_local) AS paid, min(days) AS days, r.currency
  FROM soon s JOIN vendors USING (bp_key) LEFT JOIN bp_relevance r USING (bp_key)
  GROUP BY ALL)"""

_CLEARINGS = """
clearings AS (
  SELECT bp_key, company_code, 'A' || (document_no::BIGINT // 61) AS clearing_doc,
         sum(CASE WHEN doc_type IN ('KR', 'RE') THEN amount_local ELSE 0 END)::DECIMAL(15,2) AS invoices,
         sum(CASE WHEN doc_type = 'KG' THEN amount_local ELSE 0 END)::DECIMAL(15,2) AS credits,
         sum(CASE WHEN doc_type = 'KZ' THEN amount_local ELSE 0 END)::DECIMAL(15,2) AS payments,
         sum(coalesce(cash_disc_taken, 0))::DECIMAL(15,2) AS discount, count(*) AS items,
         arg_max(item_key, (posting_date, item_key)) FILTER (doc_type = 'KZ') AS item_key
  FROM fi_item WHERE NOT is_open GROUP BY ALL),
clearing_groups AS (
  SELECT *, (payments - (invoices - credits))::DECIMAL(15,2) AS remainder FROM clearings),
overpaid AS (
  SELECT c.*, r.currency FROM clearing_groups c
  JOIN business_partner b ON b.bp_key = c.bp_key AND b.role = 'VENDOR' AND NOT b.is_one_time
  LEFT JOIN bp_relevance r ON r.bp_key = c.bp_key
  WHERE invoices > 0 AND payments > 0 AND credits = 0 AND remainder > 0)"""

# Every single line of either side, numbered, and the lines of one number matched.
_MOVES = """
lines AS (
  SELECT 'C:' || lpad((l_suppkey % 40)::VARCHAR, 10, '0') AS bp_key,
         lpad((CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END)::VARCHAR, 10, '0')
           AS document_no,
         CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN -1 ELSE 1 END AS sign,
         (l_partkey % 5 * 100 + 100)::DECIMAL(15,2) AS amount_doc FROM lineitem),
net AS (SELECT document_no, amount_doc, bp_key, sum(sign) AS n FROM lines GROUP BY ALL),
units AS (
  SELECT document_no, amount_doc, bp_key, n > 0 AS debit,
         row_number() OVER (PARTITION BY document_no, amount_doc, n > 0 ORDER BY bp_key) AS i
  FROM net, unnest(range(abs(n)::BIGINT)) AS t(x)),
moves AS (
  SELECT '1000' AS company_code, '2026' AS fiscal_year, document_no, 'EUR' AS currency, amount_doc,
         c.bp_key AS from_key, d.bp_key AS to_key, count(*) AS n
  FROM units c JOIN units d USING (document_no, amount_doc, i) WHERE NOT c.debit AND d.debit
  GROUP BY ALL),
move_pairs AS (
  SELECT least(from_key, to_key) AS a, greatest(from_key, to_key) AS b, sum(n) AS n
  FROM moves GROUP BY ALL)"""

_OFFSETS = """
sharing AS (
  SELECT 'VAT' AS kind, value_norm AS value, bp_key FROM bp_tax_id
  WHERE tax_id_type = 'VAT' AND value_norm <> ''
  UNION SELECT 'IBAN', iban_norm, bp_key FROM bp_bank_account WHERE iban_norm <> ''),
shared AS (
  SELECT s.* FROM sharing s JOIN business_partner b USING (bp_key) WHERE NOT is_one_time),
met AS (
  SELECT DISTINCT x.bp_key AS u, y.bp_key AS v FROM shared x JOIN shared y
    ON x.kind = y.kind AND x.value = y.value AND x.bp_key <> y.bp_key),
reach(a, b) AS (
  SELECT u, v FROM met UNION SELECT reach.a, met.v FROM reach JOIN met ON met.u = reach.b),
graph AS (SELECT a AS key, least(a, min(b)) AS cluster FROM reach GROUP BY a),
balances AS (
  SELECT bp_key, company_code, currency,
         sum(CASE WHEN debit_credit = 'H' THEN -amount_doc ELSE amount_doc END) AS balance
  FROM fi_item WHERE is_open GROUP BY ALL),
potential AS (
  SELECT *, least(receivable, payable) AS "offset" FROM (
    SELECT cluster, company_code, currency,
           sum(balance) FILTER (bp_key LIKE 'C:%')::DECIMAL(15,2) AS receivable,
           (-sum(balance) FILTER (bp_key LIKE 'V:%'))::DECIMAL(15,2) AS payable,
           min(bp_key) FILTER (bp_key LIKE 'C:%') AS customer,
           min(bp_key) FILTER (bp_key LIKE 'V:%') AS vendor, count(*) AS accounts
    FROM balances JOIN graph ON graph.key = bp_key GROUP BY ALL)
  WHERE receivable > 0 AND payable > 0)"""


def _sql(body: str, ctes: str) -> str:
    return with_model(body, "relevance", ctes, recursive=True)


FLOW_ORACLE = {
    "payments_after_change": _sql("SELECT * FROM soon", _CHANGES),
    "check_ap_rsk_001": _sql(rows(
        "per_change", bp_key="bp_key", role="'VENDOR'", source_table="'CDHDR'",
        source_field="'CHANGENR'", current_value="change_no",
        current_display="'Bankdaten ' || days || ' Tage vor einer Zahlung geändert, ' || n "
                        "|| ' Zahlungen'",
        impact_amount="paid", impact_currency="currency",
        impact_formula="'Summe der Zahlungen nach der Änderung'",
        finding_key="bp_key || '|' || change_no"), _CHANGES),
    "clearing_groups": _sql("SELECT * FROM clearing_groups", _CLEARINGS),
    "check_ap_lea_003": _sql(rows(
        "overpaid", bp_key="bp_key", role="'VENDOR'", company_code="company_code",
        source_table="'BSAK'", source_field="'AUGBL'", current_value="clearing_doc",
        current_display=f"{money('payments', 'currency')} || ' gezahlt auf ' || "
                        f"{money('invoices', 'currency')}",
        impact_amount="remainder", impact_currency="currency",
        impact_formula=f"{money('payments', 'currency')} || ' abzüglich ' || "
                       f"{money('invoices', 'currency')}",
        finding_key="company_code || '|' || clearing_doc"), _CLEARINGS),
    "rebookings": "WITH " + _MOVES + "\nSELECT * FROM moves",
    "check_ar_lea_002": _sql(rows(
        "move_pairs JOIN business_partner p ON p.bp_key = a AND p.role = 'CUSTOMER' "
        "AND NOT is_one_time",
        bp_key="a", role="'CUSTOMER'", source_table="'BSAD'", source_field="'KUNNR'",
        current_value="substr(a, 3) || ' | ' || substr(b, 3)",
        current_display="n || ' Posten zwischen zwei Debitoren umgebucht'",
        finding_key="a || '|' || b || '|EUR'"), _MOVES),
    "partner_graph": _sql("SELECT key, cluster FROM graph", _OFFSETS),
    "offset_potential": _sql("SELECT * FROM potential", _OFFSETS),
    "check_cross_lea_001": _sql(rows(
        "potential", bp_key="customer", role="'CUSTOMER'", company_code="company_code",
        source_table="'BSID'", source_field="'KUNNR'", current_value="customer",
        current_display=f"'Forderung ' || {money('receivable', 'currency')} || "
                        f"' und Verbindlichkeit ' || {money('payable', 'currency')} || "
                        "' beim selben Partner'",
        impact_amount='"offset"', impact_currency="currency",
        impact_formula="'Kleinerer Betrag von Forderung und Verbindlichkeit'",
        finding_key="cluster || '|' || company_code || '|' || currency"), _OFFSETS),
}
