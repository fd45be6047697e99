"""DuckDB SQL for the registered queries, by query name."""

from __future__ import annotations

from oracle.checks_sql import (
    CLUSTERS,
    DISCOUNT_BUCKETS,
    MATCHES,
    RULE_SQL,
    german,
    mask,
    money,
    rule_sql,
    with_findings,
)
from oracle.model_sql import with_model

ORACLE: dict[str, str] = {}

# -- text to value ------------------------------------------------------------------------
_PRICES = """
prices AS (
    SELECT l_orderkey, l_linenumber, l_orderkey % 8 AS form,
           l_extendedprice::DECIMAL(15,2) AS price, floor(l_extendedprice)::BIGINT AS whole
    FROM lineitem
),
price_texts AS (
    SELECT *, CASE form
        WHEN 0 THEN translate(format('{:,.2f}', price), ',.', '.,')
        WHEN 1 THEN price::VARCHAR
        WHEN 2 THEN translate(format('{:,.2f}', price), ',.', '.,') || '-'
        WHEN 3 THEN '+' || price
        WHEN 4 THEN format('{:,.2f}', price)
        WHEN 5 THEN translate(format('{:,.2f}', price), ',.', ' ,')
        WHEN 6 THEN translate(format('{:,}', whole), ',', '.')
        ELSE 'n/a' END AS text,
        CASE form WHEN 2 THEN -price WHEN 6 THEN whole WHEN 7 THEN NULL ELSE price
            END::DECIMAL(15,2) AS value
    FROM prices
)"""
ORACLE["parse_amount"] = f"""WITH {_PRICES}
SELECT l_orderkey, l_linenumber, text, value AS value_de,
       CASE WHEN form = 6 AND whole >= 1000 THEN NULL ELSE value END AS value_iso,
       CASE WHEN form = 6 AND whole >= 1000 THEN NULL ELSE value END AS value_none
FROM price_texts"""
ORACLE["parse_array"] = f"""WITH {_PRICES}
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, text)::INTEGER
       AS place, text, value FROM price_texts"""
ORACLE["value_notation"] = f"""WITH {_PRICES}
SELECT form::INTEGER AS form, CASE WHEN form IN (0, 2, 5) THEN 'de' WHEN form IN (1, 3, 4) THEN 'iso' END
       AS notation, count(*) AS n
FROM price_texts GROUP BY ALL"""
ORACLE["parse_percent"] = """
SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN replace(rate::VARCHAR, '.', ',')
           WHEN 1 THEN rate::VARCHAR WHEN 2 THEN '1.' || rate || ',0'
           ELSE rate::INTEGER::VARCHAR END AS text,
       CASE WHEN l_orderkey % 4 <> 2 THEN rate END AS value
FROM (SELECT *, (l_discount * 100)::DECIMAL(5,3) AS rate FROM lineitem)"""
ORACLE["parse_date"] = """
SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6
           WHEN 0 THEN strftime(l_shipdate, '%Y%m%d') WHEN 1 THEN strftime(l_shipdate, '%d.%m.%Y')
           WHEN 2 THEN strftime(l_shipdate, '%-d.%-m.%Y')
           WHEN 3 THEN strftime(l_shipdate, ' %Y-%m-%d ')
           WHEN 4 THEN '31.02.' || year(l_shipdate) ELSE '00000000' END AS text,
       CASE WHEN l_orderkey % 6 < 4 THEN l_shipdate::DATE END AS value
FROM lineitem"""
ORACLE["parse_integer"] = """
SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN lpad(l_partkey::VARCHAR, 9, '0')
           WHEN 1 THEN l_partkey || '-' WHEN 2 THEN l_partkey || ',0'
           WHEN 3 THEN '99' || lpad(l_partkey::VARCHAR, 9, '0') ELSE '+' || l_partkey END AS text,
       CASE l_orderkey % 5 WHEN 0 THEN l_partkey WHEN 1 THEN -l_partkey WHEN 4 THEN l_partkey
           END::INTEGER AS value
FROM lineitem"""
ORACLE["parse_flag"] = """
SELECT l_orderkey, l_linenumber,
       CASE l_returnflag WHEN 'R' THEN 'X' WHEN 'A' THEN ' x ' ELSE '' END AS text,
       CASE WHEN l_returnflag IN ('R', 'A') THEN TRUE END AS value
FROM lineitem"""
ORACLE["file_notation"] = """
SELECT * FROM (VALUES ('BSAD', 'de', 'Datei'), ('BSAK', 'iso', 'Datei'), ('BSID', 'de', 'Datei'),
    ('BSIK', 'iso', 'Datei')) t("table", notation, notation_source)
WHERE (SELECT count(*) FROM orders) > 0 AND (SELECT count(*) FROM lineitem) > 0"""
ORACLE["money_text"] = f"""
SELECT o_orderkey, {money("signed", "'EUR'")} AS money,
       translate(format('{{:,}}', floor(o_totalprice)::BIGINT), ',', '.') AS digits,
       {german("o_orderdate")} AS day,
       rtrim(rtrim((o_orderkey % 100 / 20)::DECIMAL(5,3)::VARCHAR, '0'), '.') AS rate,
       (o_totalprice::DECIMAL(15,2) * 100)::BIGINT AS cents
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice::DECIMAL(15,2)
          AS signed FROM orders)"""
ORACLE["text_norms"] = """
SELECT c_custkey, 'CUSTOMER' || substr(c_name, 10) || c_custkey AS reference_norm,
       'DE12' || c_custkey AS tax_norm, 'DE1234' || c_custkey AS iban_norm,
       'muessigenanducustomer' || substr(c_name, 10) AS name_core, c_custkey::VARCHAR AS account,
       CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ', ' || c_mktsegment END
           AS display_name,
       CASE WHEN c_custkey % 7 <> 0 THEN 'C:' || lpad(c_custkey::VARCHAR, 10, '0') END AS bp_key
FROM customer"""
ORACLE["utc_text"] = """
SELECT event_id,
       CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp,
       CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%d.%m.%Y %H:%M UTC') END AS minute
FROM events"""
ORACLE["window_starts"] = """
SELECT DISTINCT o_orderdate::DATE AS day, (o_orderdate::DATE - INTERVAL 12 MONTH)::DATE AS year_before,
       o_orderdate::DATE + 180 AS later
FROM orders"""

# -- exports as files -----------------------------------------------------------------------
_TABLES = ("ADR6", "BSAD", "BSAK", "BSID", "BSIK", "KNA1", "KNB1", "KNB5", "KNBK", "KNVP", "LFA1",
           "LFB1", "LFBK", "T001", "T052", "T052U", "TIBAN")
_NAMES = ", ".join(f"('{t}', '{t}_export.txt')" for t in _TABLES)
ORACLE["file_listing"] = f"""
SELECT name, "table" FROM (VALUES {_NAMES}) t("table", name)
WHERE (SELECT count(*) FROM customer) > 0"""
_NATIONS = """(SELECT DISTINCT c_nationkey AS n,
  'name=T' || c_nationkey // 2 || '_' || c_nationkey || '.txt' AS name FROM customer)"""
ORACLE["file_collisions"] = f"""
SELECT 'NAME=T' || n // 2 AS "table", string_agg(name, ',' ORDER BY name) AS names
FROM {_NATIONS} GROUP BY n // 2 HAVING count(*) > 1"""
ORACLE["file_header_problems"] = f"""
SELECT name, CASE n % 5 WHEN 1 THEN 'column twice' WHEN 2 THEN 'blank column name'
                        ELSE 'no delimiter' END AS problem,
       CASE n % 5 WHEN 1 THEN 'SEG' WHEN 2 THEN '1' END AS "column"
FROM {_NATIONS} WHERE n % 5 BETWEEN 1 AND 3"""
ORACLE["raw_rows"] = with_model("""
SELECT 'LFB1' AS "table", id AS key, 'Kreditoren für Anlagen' AS value,
       CASE WHEN k % 83 = 7 THEN 2 ELSE 1 END::BIGINT AS n FROM derived WHERE side = 'V'
UNION ALL SELECT 'KNBK', id, name, 1 FROM derived WHERE side = 'C'
UNION ALL SELECT 'T001', ((r_regionkey + 1) * 1000)::VARCHAR, r_name, 1 FROM region
UNION ALL SELECT 'BSAK', lpad(n::VARCHAR, 10, '0'), reference, count(*)
          FROM postings WHERE side = 'AP' AND NOT is_open GROUP BY ALL""", "items")
_RAW_COUNTS = """
raw_counts AS (
    SELECT CASE side WHEN 'AR' THEN CASE WHEN is_open THEN 'BSID' ELSE 'BSAD' END
           ELSE CASE WHEN is_open THEN 'BSIK' ELSE 'BSAK' END END AS source, unreadable,
           count(*) AS n FROM postings GROUP BY ALL
    UNION ALL SELECT unnest(['KNA1', 'KNBK', 'KNVP', 'KNB5']), FALSE, count(*)
        FROM customer
    UNION ALL SELECT unnest(['LFA1', 'LFBK']), FALSE, count(*) FROM supplier
    UNION ALL SELECT CASE side WHEN 'C' THEN 'KNB1' ELSE 'LFB1' END, FALSE,
        sum(CASE WHEN k % 83 = 7 THEN 2 ELSE 1 END) FROM derived GROUP BY side
    UNION ALL SELECT 'TIBAN', FALSE, count(*) FROM derived
    UNION ALL SELECT 'ADR6', FALSE, count(*) FROM orders
    UNION ALL SELECT 'T001', FALSE, count(*) FROM region
    UNION ALL SELECT unnest(['T052', 'T052U']), FALSE, count(*) FROM nation
)"""
ORACLE["raw_row_numbers"] = with_model("""
SELECT source AS "table", sum(n)::BIGINT AS n, 1::BIGINT AS first, sum(n)::BIGINT AS last,
       sum(n)::BIGINT AS different FROM raw_counts GROUP BY source""", "items", _RAW_COUNTS)
ORACLE["file_probe"] = with_model("""
SELECT source AS "table", CASE source WHEN 'LFB1' THEN 'CP1252' WHEN 'KNBK' THEN 'UTF-16-BE'
           ELSE 'UTF-8' END AS encoding,
       CASE WHEN source IN ('T001', 'LFA1') THEN ';' ELSE chr(9) END AS delimiter,
       FALSE AS parts_differ, CASE WHEN source <> 'KNBK' THEN sum(n)::BIGINT END AS data_lines
FROM raw_counts GROUP BY source""", "items", _RAW_COUNTS)

# -- staging and canonical tables -------------------------------------------------------------
ORACLE["stage_counts"] = with_model("""
SELECT source AS "table", sum(n)::BIGINT AS rows_raw,
       sum(CASE WHEN unreadable THEN 0 ELSE n END)::BIGINT AS rows_staged,
       sum(CASE WHEN unreadable THEN n ELSE 0 END)::BIGINT AS rejected
FROM raw_counts GROUP BY source""", "items", _RAW_COUNTS)
ORACLE["control_totals"] = with_model("""
SELECT source AS "table", company_code, currency, sum(signed)::DECIMAL(15,2) AS amount
FROM staged_items GROUP BY ALL""", "items")
ORACLE["staged_rejects"] = with_model("""
SELECT 'staged' AS stage, CASE side WHEN 'AR' THEN CASE WHEN is_open THEN 'BSID' ELSE 'BSAD' END
           ELSE CASE WHEN is_open THEN 'BSIK' ELSE 'BSAK' END END AS source_table,
       row_no, CASE side WHEN 'AR' THEN 'BLDAT: Datum nicht lesbar' ELSE 'SHKZG: weder S noch H '
           || '– das Vorzeichen von amount_signed_local ist nicht bestimmbar' END AS reason,
       TRUE AS has_excerpt
FROM postings WHERE unreadable""", "items")
ORACLE["staged_items"] = with_model("""
SELECT source, document_no AS "BELNR", line_item AS "BUZEI", day AS "BUDAT", amount AS "WRBTR",
       signed AS amount_signed_local, reference AS "XBLNR",
       upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')) AS reference_norm,
       clearing_date AS "AUGDT"
FROM staged_items""", "items")
ORACLE["canonical_company_code"] = with_model("SELECT * FROM company_code", "partner")
ORACLE["canonical_business_partner"] = with_model(
    "SELECT * EXCLUDE (k, side) FROM business_partner",
    "partner")
ORACLE["canonical_bp_tax_id"] = with_model("SELECT * FROM bp_tax_id", "partner")
ORACLE["canonical_bp_company_code"] = with_model("SELECT * FROM bp_company_code", "partner")
ORACLE["canonical_bp_bank_account"] = with_model("SELECT * FROM bp_bank_account", "partner")
ORACLE["canonical_bp_partner_function"] = with_model("""
SELECT bp_key, 'RG' AS "function", 'C:' || lpad((CASE WHEN k % 13 = 4 THEN k - 1 ELSE k END)::VARCHAR,
       10, '0') AS partner_bp_key, '000' AS counter
FROM derived WHERE side = 'C'""", "partner")
ORACLE["canonical_bp_dunning"] = with_model("""
SELECT bp_key, company_code, (k % 4)::INTEGER AS dunning_level, created_on AS last_dunned_on
FROM derived WHERE side = 'C'""", "partner")
ORACLE["canonical_payment_terms"] = with_model("SELECT * FROM payment_terms", "partner")
ORACLE["canonical_fi_item"] = with_model(
    "SELECT * EXCLUDE (document_no, line_item, document_date, amount_local, baseline_date) "
    "FROM fi_item", "items")
_MASTER_REJECTS = """
SELECT CASE side WHEN 'C' THEN 'KNB1' ELSE 'LFB1' END AS source_table, k * 2 + c AS row_no,
       'bp_key/company_code ' || bp_key || '|' || company_code || ' kommt in '
       || CASE side WHEN 'C' THEN 'KNB1' ELSE 'LFB1' END
       || ' mehrfach vor – keine der Zeilen wird uebernommen' AS reason
FROM derived, (VALUES (0), (1)) copies(c) WHERE k % 83 = 7"""
_CANONICAL_REJECTS = f"""
canonical_rejects AS (
    SELECT 'canonical' AS stage, source AS source_table, row_no, reason
    FROM judged_items WHERE reason IS NOT NULL
    UNION ALL SELECT 'canonical', * FROM ({_MASTER_REJECTS})
)"""
ORACLE["canonical_rejects"] = with_model("SELECT * FROM canonical_rejects", "items",
                                         _CANONICAL_REJECTS)


def _conservation(items: str, partner: str = "TRUE", company: str = "TRUE", side: str = "TRUE",
                  outside_tax: str = "0", keyless: str = "TRUE",
                  sound: str = "reason IS NULL") -> str:
    """Counts per target for a scope, each part as a condition."""
    both = f"({partner}) AND ({side})"
    return f"""
SELECT "table", "rows"::BIGINT AS "rows", rejected::BIGINT AS rejected,
       out_of_scope::BIGINT AS out_of_scope FROM (
    SELECT 'company_code' AS "table", count(*) FILTER ({keyless}) AS "rows", 0 AS rejected,
           count(*) FILTER (NOT ({keyless})) AS out_of_scope FROM company_code
    UNION ALL SELECT 'business_partner', count(*) FILTER ({both}), 0,
           count(*) FILTER (NOT ({both})) FROM derived
    UNION ALL SELECT 'bp_tax_id', 2 * count(*) FILTER ({both}), 0, {outside_tax} FROM derived
    UNION ALL SELECT 'bp_company_code',
           count(*) FILTER (({company}) AND ({side}) AND k % 83 <> 7),
           2 * count(*) FILTER (({company}) AND ({side}) AND k % 83 = 7),
           sum(CASE WHEN ({company}) AND ({side}) THEN 0 WHEN k % 83 = 7 THEN 2 ELSE 1 END)
           FROM derived
    UNION ALL SELECT 'bp_bank_account', count(*) FILTER ({both}), 0,
           count(*) FILTER (NOT ({both})) FROM derived
    UNION ALL SELECT 'bp_partner_function', count(*) FILTER ({partner}), 0,
           count(*) FILTER (NOT ({partner})) FROM derived WHERE side = 'C'
    UNION ALL SELECT 'bp_dunning', count(*) FILTER ({company}), 0,
           count(*) FILTER (NOT ({company})) FROM derived WHERE side = 'C'
    UNION ALL SELECT 'payment_terms', count(*), 0, 0 FROM payment_terms
    UNION ALL SELECT 'fi_item', count(*) FILTER (({items}) AND ({sound})),
           count(*) FILTER (({items}) AND NOT ({sound})),
           count(*) FILTER (NOT ({items})) FROM judged_items)"""


ORACLE["conservation"] = with_model(_conservation("TRUE"), "items")
ORACLE["scope_company_codes"] = with_model(_conservation(
    "company_code = '1000'", partner="company_code = '1000'", company="company_code = '1000'",
    keyless="company_code = '1000'"), "items")
# without vendor items nobody else holds a key: an order is one posting
ORACLE["scope_side"] = with_model(_conservation(
    "side = 'AR'", side="side = 'C'", outside_tax="count(*) FILTER (side = 'V')",
    sound="reason IS NULL OR contains(reason, 'steht bereits')"), "items")
ORACLE["scope_posting_window"] = with_model(_conservation(
    "day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"), "items")
ORACLE["delivered_window"] = with_model(
    "SELECT min(day) AS posting_date_from, max(day) AS posting_date_to FROM staged_items", "items")
ORACLE["email_choice"] = """
SELECT lpad(o_custkey::VARCHAR, 10, '0') AS address_id,
       'prio' || min(left(o_orderpriority, 1)) || '.' || o_custkey || '@example.com' AS email,
       count(DISTINCT left(o_orderpriority, 1)) > 1 AS ambiguous
FROM orders GROUP BY o_custkey"""
ORACLE["iban_choice"] = with_model("""
SELECT bank_key, account_number, iban_norm, iban_valid, valid_from, FALSE AS ambiguous
FROM iban_checked""", "partner")
ORACLE["iban_validity"] = with_model(
    f"SELECT iban_norm, iban_valid AS valid, {mask('iban_norm')} AS masked FROM iban_checked",
    "partner")
ORACLE["terms_text_choice"] = with_model("SELECT * FROM terms_texts", "partner")
ORACLE["terms_text"] = with_model("""
SELECT terms_key, arg_min(description, day_limit) AS terms_text FROM payment_terms
GROUP BY terms_key""", "partner")
ORACLE["unknown_vat_prefixes"] = with_model("""
SELECT left(value_norm, 2) AS prefix, count(*) AS n FROM bp_tax_id
WHERE tax_id_type = 'VAT' AND value_norm LIKE 'XX%' GROUP BY ALL""", "partner")
ORACLE["tiered_terms"] = with_model(
    "SELECT terms_key, count(*) AS n FROM payment_terms GROUP BY ALL HAVING count(*) > 1",
    "partner")

# -- relevance -------------------------------------------------------------------------------
ORACLE["house_currency"] = with_model("SELECT DISTINCT currency FROM company_code", "partner")
ORACLE["data_as_of"] = with_model("SELECT as_of, 'Daten' AS source FROM run")
ORACLE["partner_relevance"] = with_model("SELECT * FROM bp_relevance")
ORACLE["relevance_totals"] = with_model("""
SELECT count(*) AS partners, sum(open_items_local)::DECIMAL(15,2) AS open_items_total,
       sum(volume_12m_local)::DECIMAL(15,2) AS volume_12m_total FROM bp_relevance""")
ORACLE["status_distribution"] = with_model("""
SELECT position::INTEGER AS position, s AS activity_status, count(r.bp_key) AS n
FROM (VALUES (0, 'active'), (1, 'dormant'), (2, 'never_posted')) o(position, s)
LEFT JOIN bp_relevance r ON r.activity_status = s GROUP BY ALL""")
ORACLE["unclassified_doc_types"] = with_model("""
SELECT 'CUSTOMER' AS role, doc_type, count(*) AS n FROM fi_item WHERE doc_type = 'AB'
GROUP BY ALL""", "items")
ORACLE["doc_type_membership"] = with_model("""
SELECT CASE WHEN doc_type IN ('DR', 'DG') THEN 'AR' ELSE 'AP' END AS side, doc_type,
       count(*) AS n FROM fi_item WHERE doc_type IN ('DR', 'DG', 'KR', 'RE', 'KG') GROUP BY ALL""",
                                           "items")
ORACLE["dunning_levels"] = with_model("""
SELECT bp_key, company_code, oldest, level::INTEGER AS dunning_level,
       least(oldest + level * 30, as_of) AS last_dunned_on
FROM (SELECT *, CASE WHEN as_of - oldest >= 90 THEN 3 WHEN as_of - oldest >= 60 THEN 2
                     WHEN as_of - oldest >= 30 THEN 1 END AS level
      FROM (SELECT bp_key, company_code, min(document_date) AS oldest FROM fi_item
            WHERE is_open AND debit_credit = 'S' AND bp_key LIKE 'C:%' GROUP BY ALL), run)
WHERE level IS NOT NULL""")

# -- checks -----------------------------------------------------------------------------------
for _rule in RULE_SQL:
    ORACLE["check_" + _rule.lower().replace("-", "_")] = rule_sql(_rule)
ORACLE["invoice_terms"] = with_model("""
SELECT bp_key, company_code, sum(c)::BIGINT AS invoices, count(*) AS variants,
       arg_min(t, (-c, t)) AS top_terms, max(c) AS top_n
FROM (SELECT bp_key, company_code, payment_terms AS t, count(*) AS c FROM fi_item
      WHERE doc_type = 'DR' AND payment_terms IS NOT NULL GROUP BY ALL) GROUP BY ALL""", "items")
ORACLE["open_invoices"] = with_model("""
SELECT bp_key, company_code, count(*) AS invoices, sum(amount_doc)::DECIMAL(15,2) AS total,
       min(currency) AS invoice_currency FROM fi_item
WHERE doc_type = 'DR' AND debit_credit = 'S' AND is_open GROUP BY ALL""", "items")
ORACLE["discount_buckets"] = with_model("""
SELECT bp_key, company_code, 'EUR' AS currency, n AS invoices, abroad AS foreign_invoices, late,
       loss, base::DECIMAL(15,2) AS discount_base, n_expired, expired::DECIMAL(15,2) AS amount_expired,
       n_running, running::DECIMAL(15,2) AS amount_running, terms_key, rate,
       days AS discount_days, mean_day, first_day::INTEGER AS first_day, last_day::INTEGER AS last_day
FROM discount""", "relevance", DISCOUNT_BUCKETS)
ORACLE["shared_iban_members"] = with_model("""
SELECT iban_norm, bp_key FROM vendor_ibans
WHERE iban_norm IN (SELECT iban_norm FROM vendor_ibans GROUP BY ALL HAVING count(*) > 1)""",
                                           "partner", CLUSTERS)
ORACLE["payer_links"] = with_model("SELECT * FROM links WHERE bp_key <> other", "partner", CLUSTERS)
ORACLE["cross_role_values"] = with_model("""
SELECT criterion, shown AS value, count(DISTINCT customer) AS customers,
       count(DISTINCT vendor) AS vendors
FROM (SELECT c.bp_key AS customer, v.bp_key AS vendor, criterion, value, c.shown
      FROM account_values c JOIN account_values v USING (criterion, value)
      WHERE c.role = 'CUSTOMER' AND v.role = 'VENDOR')
GROUP BY criterion, value, shown""", "partner", MATCHES)
ORACLE["cross_role_members"] = with_model("""
SELECT criterion, shown AS value, role, bp_key FROM account_values
WHERE (criterion, value) IN (SELECT (criterion, value) FROM account_values
                             GROUP BY criterion, value HAVING count(DISTINCT role) = 2)""",
                                          "partner", MATCHES)
ORACLE["netted_invoices"] = with_model("""
SELECT item_key, document_date, amount_doc FROM fi_item i
WHERE doc_type IN ('KR', 'RE') AND debit_credit = 'H' AND NOT is_open
  AND EXISTS (SELECT 1 FROM fi_item g WHERE g.doc_type = 'KG' AND g.debit_credit = 'S'
              AND g.bp_key = i.bp_key AND g.currency = i.currency AND g.amount_doc = i.amount_doc
              AND g.document_date BETWEEN i.document_date AND i.document_date + 180)""", "items")
ORACLE["vat_without_pattern"] = with_model(r"""
SELECT bp_key, value_norm FROM bp_tax_id
WHERE tax_id_type = 'VAT' AND NOT regexp_full_match(value_norm,
    '(ATU\d{8}|BE[01]\d{9}|CHE\d{9}(MWST|TVA|IVA)?|DE\d{9}|EL\d{9}|ES[A-Z0-9]\d{7}[A-Z0-9]|'
    || 'FR[A-Z0-9]{2}\d{9}|IT\d{11}|NL\d{9}B\d{2}|PL\d{10})')""", "partner")
ORACLE["reject_candidates_null_safe"] = with_model("""
SELECT double_invoice_check IS NOT DISTINCT FROM TRUE AS is_set, count(*) AS n
FROM bp_company_code GROUP BY ALL""", "partner")

# -- findings ----------------------------------------------------------------------------------
_BRIEF = """
SELECT finding_id, rule_id, side, category, severity, damage_class, tier, action_type, bp_key,
       company_code, display_name, current_value, proposed_value, impact_amount::VARCHAR AS impact,
       'open' AS status FROM findings"""
for _name in ("all_checks", "findings_round_trip", "full_run"):
    ORACLE[_name] = with_findings(_BRIEF)
ORACLE["finding_relevance"] = with_findings("""
SELECT finding_id, open_items_local::VARCHAR AS open_items, volume_12m_local::VARCHAR AS volume_12m,
       r.currency, strftime(last_activity_on, '%Y-%m-%d') AS last_activity_on
FROM findings f JOIN bp_relevance r USING (bp_key)""")
ORACLE["finding_titles"] = with_findings("""
SELECT rule_id, count(*) AS titles, TRUE AS short, FALSE AS unfilled FROM findings GROUP BY rule_id""")
ORACLE["finding_violations"] = with_findings("""
SELECT finding_id, rule_id, 'bank data is never tier A' AS violation FROM findings
WHERE damage_class = 1
UNION ALL SELECT finding_id, rule_id, 'tier A and B need a proposal' FROM findings
WHERE damage_class = 1
UNION ALL SELECT finding_id, rule_id, 'mass_change only with tier A' FROM findings
WHERE action_type = 'mass_change'""")
ORACLE["finding_collisions"] = with_findings("""
SELECT finding_id, 2::BIGINT AS n, rule_id AS first_rule, rule_id AS last_rule FROM findings
WHERE category = 'leakage'""")
ORACLE["duplicate_finding_ids"] = with_findings("""
SELECT finding_id, 2::BIGINT AS n, 'a.json,b.json' AS files FROM findings WHERE tier = 'B'""")

# -- decisions -----------------------------------------------------------------------------------
_MEMORY = """
digits AS (SELECT *, substr(finding_id, 3, 1) AS d FROM findings),
memory AS (
    SELECT CASE WHEN d = 'a' THEN 'F-x' || substr(finding_id, 4, 11) ELSE finding_id END AS finding_id,
           rule_id, bp_key, CASE WHEN d < '2' THEN 'accepted_risk' WHEN d < '5' THEN 'data_correct'
           ELSE 'not_relevant' END AS reason_code, d
    FROM digits WHERE d <= 'a'
)"""
ORACLE["memory_applied"] = with_findings("""
SELECT finding_id, CASE WHEN d < '2' THEN 'accepted_risk' WHEN d <= '9' THEN 'rejected'
           ELSE 'open' END AS status,
       CASE WHEN d < '2' THEN 'accepted_risk' WHEN d < '5' THEN 'data_correct'
           WHEN d <= '9' THEN 'not_relevant' END AS reason_code,
       CASE WHEN d <= '9' THEN '2026-01-02T10:00:00' END AS at FROM digits""", _MEMORY)
ORACLE["memory_summary"] = with_findings("""
SELECT count(*) AS loaded, count(*) FILTER (d <> 'a') AS applied, count(*) FILTER (d = 'a') AS orphans
FROM memory""", _MEMORY)
ORACLE["memory_orphans"] = with_findings(
    "SELECT finding_id, rule_id, bp_key FROM memory WHERE d = 'a'", _MEMORY)
ORACLE["memory_problems"] = with_findings("""
SELECT finding_id, 'missing: reason' AS problem FROM memory WHERE d = '5'
UNION ALL SELECT finding_id, 'unknown reason_code' FROM memory WHERE d = '3'
UNION ALL SELECT finding_id, 'decided_at is no time' FROM memory WHERE d = '4'
UNION ALL SELECT finding_id, 'finding_id twice' FROM memory WHERE d = '6'""", _MEMORY)
ORACLE["memory_mismatches"] = with_findings("""
SELECT finding_id, 'AR-VAL-004' AS rule_id, bp_key, rule_id AS found_rule, bp_key AS found_bp_key
FROM memory WHERE d = '7'""", _MEMORY)
ORACLE["memory_round_trip"] = with_findings("""
SELECT finding_id, rule_id, bp_key, 'Prüfer' AS decided_by,
       TIMESTAMP '2026-01-02 10:00:00' AS decided_at, reason_code, 'geprüft' AS reason
FROM memory""", _MEMORY)
_RECORDS = """
digits AS (SELECT *, substr(finding_id, 3, 1) AS d FROM findings),
records AS (
    SELECT finding_id, CASE WHEN d < '5' THEN 'accept' WHEN d < '8' THEN 'assign' ELSE 'reject' END
               AS action,
           CASE d WHEN '8' THEN 'accepted_risk' WHEN '9' THEN 'data_correct' END AS reason_code,
           CASE WHEN d = '1' THEN 'eigener Grund' WHEN d < '5' THEN 'Vorschlag übernommen'
                WHEN d = '6' THEN 'Zugewiesen an Kollegin' WHEN d < '8' THEN 'Zugewiesen an unbekannt'
                WHEN d = '8' THEN 'Risiko akzeptiert' WHEN d = '9' THEN 'Daten sind korrekt'
                ELSE 'Abgelehnt' END AS reason,
           CASE WHEN d = '6' THEN 'Kollegin' END AS assigned_to, 'Prüfer' AS by,
           '2026-01-02T10:00:00Z' AS at, d
    FROM digits WHERE d < 'c'
)"""
for _name in ("decision_records", "decision_round_trip"):
    ORACLE[_name] = with_findings("SELECT * EXCLUDE (d) FROM records", _RECORDS)
ORACLE["decision_overlay"] = with_findings("""
SELECT f.finding_id, CASE WHEN r.d IS NULL THEN 'open' WHEN r.d < '8' THEN 'in_progress'
           WHEN r.d = '8' THEN 'accepted_risk' ELSE 'rejected' END AS status, r.reason
FROM findings f LEFT JOIN records r USING (finding_id)""", _RECORDS)
ORACLE["decision_problems"] = with_findings("""
SELECT finding_id, CASE d WHEN '2' THEN 'unknown action' ELSE 'at is not UTC' END AS problem
FROM records WHERE d IN ('2', '3')""", _RECORDS)
ORACLE["decision_import"] = with_findings("""
SELECT count(*) AS total, count(*) FILTER (category <> 'leakage') AS applied,
       count(*) FILTER (category = 'leakage') AS missing, 'other-run' AS file_run,
       'derived-run' AS loaded_run, TRUE AS run_mismatch,
       (SELECT count(*) FROM reviewed) AS samples_total,
       (SELECT count(*) FROM reviewed WHERE rule_id IN (
           SELECT rule_id FROM findings WHERE category <> 'leakage')) AS samples_applied
FROM records JOIN findings USING (finding_id)""", _RECORDS + """,
reviewed AS (SELECT DISTINCT rule_id FROM findings
             WHERE damage_class <> 1 AND NOT contains(rule_id, 'LEA'))""")
ORACLE["decision_file"] = with_findings("""
SELECT 'decisions' AS format, 1 AS format_version, 'derived-run' AS run_id,
       (SELECT strftime(as_of, '%Y-%m-%d') FROM run) AS data_as_of,
       '2026-01-02T10:00:00Z' AS exported_at, 'P' AS exported_by,
       count(*) AS decisions, 0::BIGINT AS reviews FROM records""", _RECORDS)
ORACLE["decision_import_missing"] = with_findings("""
SELECT finding_id FROM records JOIN findings USING (finding_id) WHERE category = 'leakage'""",
                                                  _RECORDS)
ORACLE["decision_log"] = """
SELECT 'F-' || user_id AS finding_id, event_type AS action, event_id
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id
                                                      ORDER BY ts DESC, event_id DESC) = 1)
WHERE event_type <> 'error'"""
_CLEANUP = """
SELECT bp_key, coalesce(company_code, '') AS company_code, source_table, source_field,
       coalesce(current_value, '') AS current, coalesce(proposed_value, '') AS proposed, tier,
       f.rule_id{extra}
FROM findings f JOIN records r USING (finding_id)
WHERE action_type = 'mass_change' AND r.action = 'accept'"""
ORACLE["cleanup_list"] = with_findings(_CLEANUP.format(extra=", finding_id"), _RECORDS)
ORACLE["cleanup_round_trip"] = with_findings(_CLEANUP.format(extra=""), _RECORDS)

# -- exploration -----------------------------------------------------------------------------------
ORACLE["filter_findings"] = with_findings(
    _BRIEF + " WHERE side = 'AR' AND severity = 'high'")
ORACLE["filter_no_company_code"] = with_findings(
    _BRIEF + " WHERE company_code IS NULL AND tier = 'B'")
_TITLE_HIT = "contains(lower(display_name), 'ort 1')"
ORACLE["search_findings"] = with_findings(_BRIEF + f" WHERE {_TITLE_HIT}")
ORACLE["visible_findings"] = with_findings(
    _BRIEF + " WHERE action_type = 'decision' AND rule_id = 'AR-CON-002'")
_SEVERITY = "list_position(['low', 'medium', 'high', 'critical'], severity)"
ORACLE["sorted_by_tier"] = with_findings(f"""
SELECT finding_id, list_position(['A', 'B', 'C', 'decision'], tier)::BIGINT AS tier_rank,
       {_SEVERITY}::BIGINT AS severity_rank, 1::BIGINT AS status_rank
FROM findings""")
ORACLE["top_findings"] = with_findings(
    _BRIEF + f" WHERE impact_amount IS NOT NULL ORDER BY impact_amount DESC, {_SEVERITY} DESC, "
    "finding_id LIMIT 10")
ORACLE["company_code_options"] = with_findings(
    "SELECT DISTINCT coalesce(company_code, 'none') AS company_code FROM findings")
ORACLE["overview"] = with_findings("""
SELECT count(*) AS total, count(*) AS open, 0::BIGINT AS decided,
       count(*) FILTER (impact_amount IS NULL) AS without_impact FROM findings""")
ORACLE["tier_counts"] = with_findings("""
SELECT position::INTEGER AS position, t AS tier, count(f.finding_id) AS n
FROM (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'decision')) o(position, t)
LEFT JOIN findings f ON f.tier = t GROUP BY ALL""")
ORACLE["tab_counts"] = with_findings("""
SELECT position::INTEGER AS position, t AS action_type, count(f.finding_id) AS n
FROM (VALUES (0, 'mass_change'), (1, 'review'), (2, 'decision'), (3, 'process')) o(position, t)
LEFT JOIN findings f ON f.action_type = t AND f.side = 'AP' GROUP BY ALL""")
ORACLE["totals_by_currency"] = with_findings("""
SELECT impact_currency AS currency, sum(impact_amount)::DECIMAL(25,2) AS amount FROM findings
WHERE impact_amount IS NOT NULL GROUP BY ALL""")
ORACLE["category_totals"] = with_findings("""
SELECT category, impact_currency AS currency, sum(impact_amount)::DECIMAL(25,2) AS amount
FROM findings WHERE impact_amount IS NOT NULL GROUP BY ALL""")
ORACLE["category_summary"] = with_findings("""
SELECT category, count(*) AS n, count(*) FILTER (impact_amount IS NULL) AS without_impact
FROM findings GROUP BY ALL""")
ORACLE["rule_groups"] = with_findings("""
SELECT rule_id, arg_min(tier, finding_id) AS tier, min(tier) <> max(tier) AS mixed_tier,
       count(*) AS total, count(*) AS open, count(*) FILTER (damage_class <> 1) AS releasable,
       count(*) FILTER (damage_class = 1) AS bank_data,
       coalesce(sum(impact_amount), 0)::DECIMAL(25,2) AS impact
FROM findings GROUP BY rule_id""")
ORACLE["finding_flags"] = with_findings("""
SELECT finding_id, TRUE AS open, TRUE AS relevant, damage_class <> 1 AS releasable,
       CASE WHEN damage_class = 1 THEN 'Bankdaten: Vier-Augen erforderlich – nur Review'
            WHEN default_tier_is_decision THEN 'Erst eine der Optionen wählen' END AS blocked
FROM (SELECT *, tier = 'decision' AS default_tier_is_decision FROM findings)""")
ORACLE["sorted_evidence"] = with_findings("""
SELECT finding_id, rule_id, CASE rule_id WHEN 'AP-CON-001' THEN 'false,false'
           WHEN 'AP-LEA-002' THEN 'false,true,true' WHEN 'AP-LEA-001' THEN 'true,true'
           WHEN 'AR-LEA-001' THEN CASE WHEN proposed_display LIKE 'Keine%' THEN 'false,true'
                                       ELSE 'true,true' END
           ELSE 'true,true' END AS agrees
FROM findings WHERE rule_id IN ('AP-CON-001', 'AP-LEA-002', 'AP-LEA-001', 'AR-LEA-001')
   OR (rule_id = 'CROSS-DUP-001' AND contains(current_value, ' / '))""")
_EVIDENCE_COUNT = """CASE WHEN rule_id = 'AP-LEA-002' THEN 3
    WHEN rule_id IN ('AP-CON-001', 'AP-LEA-001', 'AR-LEA-001') THEN 2
    WHEN rule_id = 'CROSS-DUP-001' AND contains(current_value, ' / ') THEN 2 ELSE 1 END"""
ORACLE["match_reasons"] = with_findings(f"""
SELECT finding_id, rtrim(repeat('Name|Adresse|', {_EVIDENCE_COUNT}), '|') AS reasons,
       rtrim(repeat('after Netting ', {_EVIDENCE_COUNT})) AS note, 'after Netting' AS netting
FROM findings""")
_RECORD_MEMBERS = f"""
finding_members AS (
    SELECT f.finding_id, unnest(string_split(c.members, ',')) AS bp_key,
           {mask('c.iban_norm')} AS iban_masked
    FROM findings f JOIN clusters c ON c.anchor = f.bp_key AND {mask('c.iban_norm')} = f.current_value
    WHERE f.rule_id = 'AP-CON-001'
    UNION ALL
    SELECT f.finding_id, unnest(list_append(string_split(g.vendors, ','), g.customer)),
           (SELECT max(m.shown) FROM matches m
            WHERE m.customer = g.customer AND criterion = 'Bankverbindung')
    FROM findings f JOIN match_groups g ON g.customer = f.bp_key WHERE f.rule_id = 'CROSS-DUP-001'
),
record_values AS (
    SELECT m.finding_id, m.bp_key, u.field, u.value
    FROM finding_members m JOIN business_partner b USING (bp_key) JOIN bp_relevance r USING (bp_key)
    LEFT JOIN (SELECT bp_key, max(value) AS vat FROM bp_tax_id WHERE tax_id_type = 'VAT' GROUP BY ALL) v
      USING (bp_key),
    LATERAL (VALUES ('name', b.name1), ('street', b.street), ('postal_code', b.postal_code),
        ('city', b.city), ('country', b.country), ('vat_id', v.vat), ('iban_masked', m.iban_masked),
        ('payment_terms', NULL), ('open_items', r.open_items_local::VARCHAR),
        ('currency', r.currency), ('last_activity_on', strftime(r.last_activity_on, '%Y-%m-%d')))
        u(field, value)
)"""
ORACLE["record_comparison"] = with_findings("""
SELECT finding_id, field, min(coalesce(value, '')) AS low, max(coalesce(value, '')) AS high,
       count(DISTINCT coalesce(value, '')) > 1 AS differs, count(value) = 0 AS missing
FROM record_values GROUP BY finding_id, field""", _RECORD_MEMBERS)
_VALUE_KEY = "left(sha1({} || '|' || {}), 16)"
ORACLE["finding_members"] = with_model(f"""
SELECT 'AP-CON-001' AS rule_id, {_VALUE_KEY.format("'IBAN'", "iban_norm")} AS value_key,
       {mask('iban_norm')} AS shown, 'VENDOR' AS role, bp_key
FROM vendor_ibans SEMI JOIN clusters USING (iban_norm)
UNION ALL
SELECT DISTINCT 'CROSS-DUP-001', {_VALUE_KEY.format('criterion', 'value')}, shown, role, bp_key
FROM account_values
WHERE (criterion, value) IN (SELECT (criterion, value) FROM account_values
                             GROUP BY criterion, value HAVING count(DISTINCT role) = 2)""",
                                       "partner", CLUSTERS + "," + MATCHES)
ORACLE["finding_values"] = with_findings(f"""
SELECT finding_id, {_VALUE_KEY.format("'IBAN'", "iban_norm")} AS value_key
FROM findings f JOIN clusters c ON c.anchor = f.bp_key AND {mask('c.iban_norm')} = f.current_value
WHERE f.rule_id = 'AP-CON-001'
UNION ALL
SELECT DISTINCT finding_id, {_VALUE_KEY.format('criterion', 'value')}
FROM findings f JOIN account_values v ON v.bp_key = f.bp_key
WHERE f.rule_id = 'CROSS-DUP-001'
  AND (criterion, value) IN (SELECT (criterion, value) FROM account_values
                             GROUP BY criterion, value HAVING count(DISTINCT role) = 2)""")

# -- sampling ------------------------------------------------------------------------------------
_SAMPLE = """
sample AS (
    SELECT rule_id, finding_id, row_number() OVER (PARTITION BY rule_id
        ORDER BY sha256('derived-run|' || rule_id || '|' || finding_id), finding_id)::INTEGER AS place
    FROM findings WHERE damage_class <> 1
    QUALIFY place <= 10
)"""
ORACLE["finding_sample"] = with_findings("SELECT * FROM sample", _SAMPLE)
ORACLE["sample_progress"] = with_findings("""
SELECT *, CASE WHEN rejected_id IS NOT NULL THEN 'blocked' WHEN decided < size THEN 'continue'
               WHEN accepted = size THEN 'release' ELSE 'incomplete' END AS step
FROM (SELECT rule_id, count(*) AS size, count(action) AS decided,
             count(*) FILTER (action = 'accept') AS accepted,
             count(*) FILTER (action = 'assign') AS assigned,
             arg_min(finding_id, place) FILTER (action = 'reject') AS rejected_id
      FROM sample LEFT JOIN (SELECT finding_id, action FROM records) USING (finding_id)
      GROUP BY rule_id)""", _RECORDS + "," + _SAMPLE)
ORACLE["group_release"] = with_findings("""
SELECT finding_id, 'accept' AS action, NULL::VARCHAR AS reason_code,
       'Über Stichprobe der Regelgruppe freigegeben (' || size || ' von ' || total || ' geprüft)'
           AS reason, NULL::VARCHAR AS assigned_to, 'Prüfer' AS by, '2026-01-02T10:00:00Z' AS at
FROM findings JOIN (SELECT rule_id, count(*) AS total FROM findings GROUP BY ALL) USING (rule_id)
JOIN (SELECT rule_id, count(*) AS size FROM sample GROUP BY ALL) USING (rule_id)
WHERE damage_class <> 1 AND NOT contains(rule_id, 'LEA')
  AND finding_id NOT IN (SELECT finding_id FROM sample)""", _SAMPLE)
ORACLE["group_reviews"] = with_findings("""
SELECT DISTINCT rule_id, 'released' AS outcome, NULL::VARCHAR AS blocked_by_finding_id,
       'Prüfer' AS by, '2026-01-02T10:00:00Z' AS at
FROM sample WHERE NOT contains(rule_id, 'LEA')""", _SAMPLE)
ORACLE["review_ids"] = with_findings("""
SELECT rule_id, 'sampled' AS part, finding_id FROM sample WHERE NOT contains(rule_id, 'LEA')
UNION ALL
SELECT rule_id, 'applied', finding_id FROM findings
WHERE damage_class <> 1 AND NOT contains(rule_id, 'LEA')
  AND finding_id NOT IN (SELECT finding_id FROM sample)""", _SAMPLE)
ORACLE["document_pairs"] = with_findings("""
SELECT f.finding_id, position::INTEGER AS position, company_code || '/' || fy || '/' || doc
       AS document_key, reference AS value, strftime(day, '%Y-%m-%d') AS observed_at
FROM (SELECT finding_id, company_code, bp_key, string_split(finding_key, '|') AS docs,
             string_split(current_value, ' | ') AS refs, impact_amount, impact_currency, source_summary
      FROM findings WHERE rule_id = 'AP-LEA-001') f
JOIN double_pairs p ON p.bp_key = f.bp_key AND p.doc_a = f.docs[1] AND p.doc_b = f.docs[2]
 AND p.ref_a = f.refs[1] AND p.ref_b = f.refs[2] AND p.cc = f.company_code
CROSS JOIN LATERAL (VALUES (0, p.year_a, p.doc_a, p.ref_a, p.day_a),
                           (1, p.year_b, p.doc_b, p.ref_b, p.day_b)) d(position, fy, doc, reference, day)
""", """
double_pairs AS (
    SELECT a.bp_key, a.company_code AS cc, a.document_no AS doc_a, b.document_no AS doc_b,
           a.reference AS ref_a, b.reference AS ref_b, a.fiscal_year AS year_a,
           b.fiscal_year AS year_b, a.document_date AS day_a, b.document_date AS day_b
    FROM nearest JOIN paid a ON a.item_key = a_key JOIN paid b ON b.item_key = b_key)""")

# -- expectation against run -----------------------------------------------------------------------
ORACLE["compare_runs"] = with_findings("""
SELECT bucket, rule_id, count(*) AS n FROM (
    SELECT 'known_open' AS bucket, rule_id FROM expected WHERE d = 'e' AND moved
    UNION ALL SELECT 'early', rule_id FROM expected WHERE d = 'e' AND NOT moved AND old
    UNION ALL SELECT 'unexpected', rule_id FROM expected WHERE d = 'f'
    UNION ALL SELECT 'deviating', rule_id FROM expected WHERE moved AND d <> 'e' AND d <> 'f'
    UNION ALL SELECT CASE WHEN rule_id = 'AR-VAL-001' THEN 'known_open' ELSE 'missing' END, rule_id
        FROM expected WHERE d = '0'
    UNION ALL SELECT 'rule_missing', 'AR-DUP-001'
        FROM (SELECT DISTINCT bp_key FROM expected WHERE d = '1')
) GROUP BY ALL""", """
expected AS (
    SELECT *, substr(finding_id, 3, 1) AS d,
           rule_id = 'AR-CON-002' AND substr(finding_id, 3, 1) < '4' AS moved,
           TRUE AS old
    FROM findings
)""")

# -- report ----------------------------------------------------------------------------------------
_ALL_REJECTS = _CANONICAL_REJECTS + """,
all_rejects AS (
    SELECT stage, reason FROM canonical_rejects
    UNION ALL SELECT 'staged', CASE side WHEN 'AR' THEN 'BLDAT: Datum nicht lesbar'
        ELSE 'SHKZG: weder S noch H – das Vorzeichen von amount_signed_local ist nicht bestimmbar' END
    FROM postings WHERE unreadable
),
reasons AS (SELECT stage, reason, count(*) AS n FROM all_rejects GROUP BY ALL)"""
ORACLE["reject_reasons"] = with_model("SELECT * FROM reasons", "items", _ALL_REJECTS)
ORACLE["top_reject_reasons"] = with_model("""
SELECT stage, reason, n, row_number() OVER (PARTITION BY stage ORDER BY n DESC, reason) AS place,
       greatest(count(*) OVER (PARTITION BY stage) - 5, 0) AS more
FROM reasons
QUALIFY place <= 5""", "items", _ALL_REJECTS)
ORACLE["rule_outcomes"] = with_findings(f"""
SELECT r.rule_id, CASE WHEN r.rule_id IN ('AR-COM-002', 'AP-LEA-002') THEN 'skipped'
           WHEN r.rule_id = 'AP-VAL-003' AND count(f.finding_id) > 0 THEN 'failed'
           ELSE 'executed' END AS status,
       count(f.finding_id) FILTER (r.rule_id NOT IN ('AR-COM-002', 'AP-LEA-002', 'AP-VAL-003'))
           AS findings
FROM (SELECT unnest({sorted(RULE_SQL)}) AS rule_id) r LEFT JOIN findings f USING (rule_id)
GROUP BY r.rule_id""")
ORACLE["run_totals"] = with_findings("""
SELECT (SELECT count(*) FROM findings) AS findings, count(DISTINCT source) AS tables,
       sum(n)::BIGINT AS "rows", sum(CASE WHEN unreadable THEN 0 ELSE n END)::BIGINT AS rows_staged,
       (SELECT (SELECT count(*) FROM fi_item) + (SELECT count(*) FROM bp_company_code)
           + (SELECT count(*) FROM bp_tax_id) + 2 * (SELECT count(*) FROM derived)
           + 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM payment_terms)
           + (SELECT count(*) FROM company_code))::BIGINT AS rows_canonical,
       (SELECT count(*) FROM all_rejects) AS rejects, 17::BIGINT AS rules_executed,
       0::BIGINT AS rules_skipped, 0::BIGINT AS rules_failed, 1 AS outcome
FROM raw_counts""", _RAW_COUNTS + "," + _ALL_REJECTS)
ORACLE["run_summary"] = with_findings("""
SELECT count(*) AS findings, 17::BIGINT AS rules_executed, 0::BIGINT AS rules_skipped,
       0::BIGINT AS rules_failed, 1 AS outcome, 0::BIGINT AS problems FROM findings""")
ORACLE["run_info"] = with_findings("""
SELECT 'derived-run' AS run_id, (SELECT strftime(as_of, '%Y-%m-%d') FROM run) AS data_as_of,
       '0.1.0' AS engine_version, '0.1' AS pack_version,
       string_agg(DISTINCT company_code, ',' ORDER BY company_code) AS company_codes
FROM findings""")
ORACLE["findings_file_problems"] = with_findings("""
SELECT finding_id, CASE substr(finding_id, 3, 1) WHEN '1' THEN 'missing: title'
           ELSE 'unknown action_type' END AS problem
FROM findings WHERE substr(finding_id, 3, 1) IN ('1', '2')
UNION ALL SELECT NULL, 'several values of run_id' FROM findings
HAVING count(*) FILTER (substr(finding_id, 3, 1) = '3') > 0""")
ORACLE["run_hints"] = " UNION ALL ".join(
    f"SELECT '{source}' AS source, {key}::VARCHAR AS key, {n}::BIGINT AS n FROM ({ORACLE[name]})"
    for source, name, key, n in (
        ("unknown VAT prefix", "unknown_vat_prefixes", "prefix", "n"),
        ("tiered payment terms", "tiered_terms", "terms_key", "n"),
        ("unclassified document type", "unclassified_doc_types", "doc_type", "n"),
        ("decision without finding", "memory_orphans", "finding_id", "1"),
    )) + f""" UNION ALL SELECT 'read as CP1252', 'LFB1_export.txt', 1
UNION ALL SELECT 'several e-mails', 'addresses', count(*) FROM ({ORACLE["email_choice"]})
WHERE ambiguous"""
