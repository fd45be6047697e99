"""DuckDB SQL of the canonical model, straight from the driver tables.

Written from the formulas, without the text exports the Spark side goes through: what
agrees has survived rendering, typing, mapping and rejecting.
"""

from __future__ import annotations

import re

_PARTNER = """
src AS (
    SELECT 'C' AS side, c_custkey AS k, c_name AS name, c_nationkey AS nation,
           c_custkey AS vk, c_custkey AS m, 0 AS off
    FROM customer
    UNION ALL
    SELECT 'V', k, name, nation, CASE WHEN k % 10 = 0 THEN k ELSE k + 5000000 END, m,
           CASE WHEN m % 20 = 0 THEN 0 ELSE 5000000 END
    FROM (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation,
                 CASE WHEN s_suppkey % 14 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS m
          FROM supplier)
),
derived AS (
    SELECT *, lpad(k::VARCHAR, 10, '0') AS id, side || ':' || lpad(k::VARCHAR, 10, '0') AS bp_key,
           ['DE','AT','FR','IT','NL','PL','GR','BE','ES','CH'][(nation % 10) + 1] AS country,
           lpad(((vk * 7919 + 12345) % 1000000000)::VARCHAR, 9, '0') AS n9,
           lpad((10000000 + m * 7 + off // 1000)::VARCHAR, 8, '0')
               || lpad((m * 13 + off)::VARCHAR, 10, '0') AS bban,
           CASE WHEN k % 71 <> 9 THEN DATE '1993-01-01' + (k % 2500)::INTEGER END AS created_on,
           CASE WHEN k % 3 < 2 THEN '1000' ELSE '2000' END AS company_code
    FROM src
),
business_partner AS (
    SELECT bp_key, CASE side WHEN 'C' THEN 'CUSTOMER' ELSE 'VENDOR' END AS role,
           id AS source_id, country,
           CASE WHEN k % 97 = 3 THEN 'Test ' || name WHEN k % 101 = 4 THEN 'unbekannt'
                ELSE name END AS name1,
           CASE WHEN k % 89 = 5 THEN 'MUSTER' ELSE 'Ort ' || nation END AS city,
           lpad((k % 90000)::VARCHAR, 5, '0') AS postal_code, 'Weg ' || (k % 50) AS street,
           k % 12 = 5 AS is_one_time, k % 41 = 0 AS deletion_flag, k % 53 = 1 AS central_block,
           created_on,
           CASE WHEN side = 'V' AND k % 28 = 1
                THEN 'V:' || lpad((k - 1)::VARCHAR, 10, '0') END AS alt_payer_key,
           (SELECT min('prio' || left(o.o_orderpriority, 1) || '.' || o.o_custkey
                       || '@example.com')
            FROM orders o WHERE o.o_custkey = k) AS email, k, side
    FROM derived
),
vat_parts AS (
    SELECT *, CASE WHEN side = 'V' AND k % 10 = 0 THEN 'DE' WHEN country = 'GR' THEN 'EL'
                   ELSE country END AS p
    FROM derived
),
bp_tax_id AS (
    SELECT bp_key, 'VAT' AS tax_id_type, value,
           upper(replace(replace(value, ' ', ''), '.', '')) AS value_norm
    FROM (
        SELECT bp_key, CASE
            WHEN k % 43 = 2 THEN n9
            WHEN k % 37 = 6 THEN p || left(n9, 5)
            WHEN k % 31 = 8 THEN CASE WHEN country = 'DE' THEN 'ATU' || left(n9, 8)
                                      ELSE 'DE' || n9 END
            WHEN k % 61 = 10 THEN 'XX' || n9
            ELSE p || CASE WHEN k % 5 = 0 THEN ' ' ELSE '' END || CASE p
                WHEN 'AT' THEN 'U' || left(n9, 8) WHEN 'FR' THEN '12' || n9
                WHEN 'IT' THEN '01' || n9 WHEN 'NL' THEN n9 || 'B01' WHEN 'PL' THEN '5' || n9
                WHEN 'BE' THEN '0' || n9 WHEN 'ES' THEN 'A' || left(n9, 7) || '1'
                WHEN 'CH' THEN 'E' || n9 || 'MWST' ELSE n9 END
            END AS value
        FROM vat_parts)
    UNION ALL
    SELECT bp_key, 'TAX1', v, v
    FROM (SELECT bp_key, left(n9, 3) || '/' || substr(n9, 4, 3) || '/' || substr(n9, 7, 3) AS v
          FROM derived)
),
iban_rows AS (
    SELECT left(bban, 8) AS bank_key, substr(bban, 9, 10) AS account_number,
           'DE' || CASE WHEN k % 29 = 4 THEN '00'
               ELSE lpad((98 - (bban || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') END
               || ' ' || bban AS iban, created_on AS valid_from
    FROM derived
),
iban_newest AS (
    SELECT bank_key, account_number, iban, valid_from
    FROM iban_rows
    QUALIFY row_number() OVER (PARTITION BY bank_key, account_number
                               ORDER BY valid_from DESC NULLS LAST) = 1
),
iban_checked AS (
    SELECT *, replace(iban, ' ', '') AS iban_norm,
           substr(iban, 3, 2) BETWEEN '02' AND '98'
           AND (substr(replace(iban, ' ', ''), 5) || '1314' || substr(iban, 3, 2))::HUGEINT % 97 = 1
               AS iban_valid
    FROM iban_newest
),
bp_bank_account AS (
    SELECT d.bp_key, left(d.bban, 8) AS bank_key, substr(d.bban, 9, 10) AS account_number,
           lpad((d.k % 3 + 1)::VARCHAR, 4, '0') AS partner_bank_type, i.iban, i.iban_norm,
           i.iban_valid, i.valid_from
    FROM derived d JOIN iban_checked i
      ON i.bank_key = left(d.bban, 8) AND i.account_number = substr(d.bban, 9, 10)
),
bp_company_code AS (
    SELECT bp_key, company_code,
           CASE WHEN k % 23 <> 0 THEN 'ZB0' || (k % 5) END AS payment_terms,
           k % 59 = 2 AS posting_block, k % 67 = 4 AS deletion_flag,
           CASE WHEN side = 'V' AND k % 6 <> 0 THEN TRUE END AS double_invoice_check,
           CASE WHEN side = 'V' AND k % 42 = 1
                THEN 'V:' || lpad((k - 1)::VARCHAR, 10, '0') END AS alt_payer_key
    FROM derived WHERE NOT k % 83 = 7
),
company_code AS (
    SELECT ((r_regionkey + 1) * 1000)::VARCHAR AS company_code, r_name AS name,
           'EUR' AS currency, 'DE' AS country
    FROM region
),
terms_source AS (
    SELECT 'ZB0' || (n_nationkey % 5) AS terms_key, n_nationkey // 5 AS tier, n_nationkey AS n
    FROM nation
),
terms_texts AS (
    SELECT terms_key, 'Bedingung ' || n AS description
    FROM terms_source
    QUALIFY row_number() OVER (PARTITION BY terms_key ORDER BY
        CASE tier WHEN 1 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END) = 1
),
payment_terms AS (
    SELECT s.terms_key, (s.tier * 10)::INTEGER AS day_limit, s.n::INTEGER AS days1,
           2.000::DECIMAL(5,3) AS pct1, 30 AS days3, t.description
    FROM terms_source s JOIN terms_texts t USING (terms_key)
)"""

_ITEMS = """
ar_source AS (
    SELECT o_orderkey AS n, o_orderstatus AS status, o_orderdate::DATE AS day,
           o_totalprice::DECIMAL(15,2) AS amount,
           CASE WHEN o_custkey % 19 = 3 THEN o_custkey - 1 ELSE o_custkey END AS k,
           CASE WHEN o_orderkey % 50 = 7 THEN 'DZ' WHEN o_orderkey % 40 = 1 THEN 'DG'
                WHEN o_orderkey % 97 = 11 THEN 'AB' ELSE 'DR' END AS doc_type
    FROM orders
),
ap_source AS (
    SELECT l_orderkey AS n, l_linenumber AS line, l_linestatus AS status,
           l_quantity::INTEGER AS quantity, l_shipdate::DATE AS day,
           (floor(l_extendedprice / 2500) * 2500 + 100)::DECIMAL(15,2) AS amount,
           CASE WHEN l_suppkey % 33 = 7 THEN l_suppkey - 1 ELSE l_suppkey END AS k,
           CASE WHEN l_returnflag = 'R' AND l_quantity <= 5 THEN 'KG'
                WHEN l_orderkey % 61 = 13 THEN 'KZ' WHEN l_linenumber % 2 = 0 THEN 'KR'
                ELSE 'RE' END AS doc_type
    FROM lineitem
),
postings AS (
    SELECT 'AR' AS side, n, n AS row_no, doc_type = 'DZ' OR status = 'O' AS is_open, k,
           'C:' || lpad((CASE WHEN n % 701 = 5 THEN k + 90000000 ELSE k END)::VARCHAR, 10, '0')
               AS bp_key,
           '001' AS line_item, day, doc_type,
           CASE WHEN doc_type IN ('DZ', 'DG') THEN 'H' ELSE 'S' END AS debit_credit,
           CASE WHEN doc_type = 'DZ' AND n % 150 = 107 THEN 'A' END AS special_gl,
           CASE WHEN n % 601 <> 4 THEN 'EUR' END AS currency, amount,
           CASE WHEN doc_type = 'DZ' THEN CASE WHEN n % 100 <> 7 THEN 'ZA/' || n END
                ELSE 'rg-' || n END AS reference,
           CASE WHEN n % 4 = 0 THEN 'ZB04' ELSE 'ZB0' || (k % 5) END AS payment_terms,
           NULL::INTEGER AS days1, NULL::DECIMAL(5,3) AS pct1,
           NULL::DECIMAL(15,2) AS disc_base, NULL::DECIMAL(15,2) AS disc_taken,
           (n % 60)::INTEGER AS clear_after, n % 499 = 3 AS unreadable
    FROM ar_source
    UNION ALL
    SELECT 'AP', n, n * 10 + line, doc_type <> 'KG' AND status = 'O', k,
           'V:' || lpad(k::VARCHAR, 10, '0'), lpad(line::VARCHAR, 3, '0'), day, doc_type,
           CASE WHEN doc_type IN ('KG', 'KZ') THEN 'S' ELSE 'H' END, NULL,
           CASE WHEN line = 4 AND n % 37 = 5 THEN 'USD' ELSE 'EUR' END, amount,
           CASE WHEN doc_type = 'KG' THEN 'GS' || n ELSE 'RE' || (n % 50) END,
           'ZB0' || (k % 5), CASE WHEN k % 2 = 0 THEN 14 ELSE 0 END,
           CASE WHEN k % 2 = 0 THEN 2.000 ELSE 0.000 END::DECIMAL(5,3),
           CASE WHEN k % 2 = 0 THEN amount ELSE 0.00 END::DECIMAL(15,2),
           CASE WHEN k % 2 = 0 AND n % 9 = 0 THEN amount * 0.02 ELSE 0.00 END::DECIMAL(15,2),
           quantity, n % 499 = 3
    FROM ap_source
),
staged_items AS (
    SELECT *, CASE side WHEN 'AR' THEN CASE WHEN is_open THEN 'BSID' ELSE 'BSAD' END
                        ELSE CASE WHEN is_open THEN 'BSIK' ELSE 'BSAK' END END AS source,
           CASE WHEN k % 3 < 2 THEN '1000' ELSE '2000' END AS company_code,
           year(day)::VARCHAR AS fiscal_year, lpad(n::VARCHAR, 10, '0') AS document_no,
           CASE WHEN NOT is_open THEN day + clear_after END AS clearing_date,
           CASE WHEN debit_credit = 'H' THEN -amount ELSE amount END::DECIMAL(15,2) AS signed
    FROM postings
    WHERE NOT unreadable
),
keyed_items AS (
    SELECT *, company_code || '|' || fiscal_year || '|' || document_no || '|' || line_item
                  AS item_key,
           currency IS NULL AS no_currency,
           NOT EXISTS (SELECT 1 FROM business_partner b WHERE b.bp_key = s.bp_key) AS orphan
    FROM staged_items s
),
counted_items AS (
    SELECT *, count(*) OVER (PARTITION BY source, item_key) AS in_source
    FROM keyed_items
),
holders AS (
    SELECT item_key, min(source) AS holder
    FROM counted_items
    WHERE in_source = 1 AND NOT no_currency AND NOT orphan
    GROUP BY item_key
),
judged_items AS (
    SELECT c.*, CASE
        WHEN no_currency THEN 'fi_item.currency ist leer (WAERS)'
        WHEN orphan THEN 'Stammsatz fehlt: ' || bp_key || ' steht nicht in business_partner'
        WHEN in_source > 1 THEN 'item_key ' || c.item_key || ' kommt in ' || source
             || ' mehrfach vor – keine der Zeilen wird uebernommen'
        WHEN h.holder < source THEN 'item_key ' || c.item_key
             || ' steht bereits aus einer anderen Quelltabelle in fi_item'
        END AS reason
    FROM counted_items c LEFT JOIN holders h USING (item_key)
),
fi_item AS (
    SELECT item_key, bp_key, company_code, fiscal_year, document_no, line_item,
           day AS posting_date, day AS document_date, doc_type, debit_credit, special_gl,
           currency, amount AS amount_doc, amount AS amount_local,
           signed AS amount_signed_local, reference,
           upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')) AS reference_norm,
           day AS baseline_date, payment_terms, days1 AS cash_disc_days1,
           pct1 AS cash_disc_pct1, disc_base AS cash_disc_base, disc_taken AS cash_disc_taken,
           clearing_date, is_open
    FROM judged_items WHERE reason IS NULL
)"""

_RELEVANCE = """
run AS (
    SELECT max(coalesce(greatest(posting_date, clearing_date), posting_date)) AS as_of,
           min(posting_date) AS first_item
    FROM fi_item
),
window_days AS (SELECT as_of, (as_of - INTERVAL 12 MONTH)::DATE AS since FROM run),
delivered AS (SELECT min(day) AS window_from, max(day) AS window_to FROM staged_items),
item_sums AS (
    SELECT i.bp_key, sum(CASE WHEN is_open THEN s.f * amount_signed_local ELSE 0 END) AS open_sum,
           sum(CASE WHEN doc_type IN ('DR', 'DG', 'KR', 'RE', 'KG') AND posting_date > since
                     AND posting_date <= as_of THEN s.f * amount_signed_local ELSE 0 END) AS volume,
           max(CASE WHEN clearing_date <= as_of THEN clearing_date END) AS last_clearing,
           max(CASE WHEN posting_date <= as_of THEN posting_date END) AS last_posting
    FROM fi_item i, window_days,
         LATERAL (SELECT CASE WHEN i.bp_key LIKE 'V:%' THEN -1 ELSE 1 END AS f) s
    GROUP BY i.bp_key
),
bp_relevance AS (
    SELECT b.bp_key, coalesce(open_sum, 0)::DECIMAL(15,2) AS open_items_local,
           coalesce(volume, 0)::DECIMAL(15,2) AS volume_12m_local, 'EUR' AS currency,
           greatest(last_clearing, last_posting) AS last_activity_on,
           CASE WHEN s.bp_key IS NULL AND b.created_on > since THEN 'never_posted'
                WHEN coalesce(greatest(last_clearing, last_posting), DATE '0001-01-01') <= since
                THEN 'dormant' ELSE 'active' END AS activity_status
    FROM business_partner b CROSS JOIN window_days LEFT JOIN item_sums s ON s.bp_key = b.bp_key
)"""

_STAGES = {"partner": [_PARTNER], "items": [_PARTNER, _ITEMS],
           "relevance": [_PARTNER, _ITEMS, _RELEVANCE]}


# a table of a WITH list starts a line of its own
_ENTRY = re.compile(r"^(\w+)(\([^)]*\))? AS \(", re.M)


def statement(ctes: list[str], body: str, recursive: bool = False) -> str:
    """WITH the tables that `body` needs, each worked out once however often it is read."""
    text = ",\n".join(c.strip().rstrip(",") for c in ctes)
    starts = [m.start() for m in _ENTRY.finditer(text)] + [len(text)]
    entries = []
    for a, b in zip(starts, starts[1:]):
        entry = text[a:b].strip().rstrip(",")
        name = _ENTRY.match(entry)[1]
        entries.append((name, set(re.findall(r"\w+", entry)), entry))
    needed, kept = set(re.findall(r"\w+", body)), []
    for name, words, entry in reversed(entries):  # an entry reads those before it, or itself
        if name in needed:
            needed |= words
            own = recursive and re.search(rf"\b{name}\b", entry[len(name):])
            kept.append(entry if own else _ENTRY.sub(r"\1\2 AS MATERIALIZED (", entry, count=1))
    if not kept:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(reversed(kept)) + "\n" + body


def with_model(body: str, stage: str = "relevance", ctes: str = "", recursive: bool = False) -> str:
    """A query over the canonical tables; `ctes` are further WITH entries of its own."""
    return statement([*_STAGES[stage], *([ctes] if ctes else [])], body, recursive)
