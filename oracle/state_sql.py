"""DuckDB SQL of what lasts from run to run, and of tables told by their columns."""

from __future__ import annotations

from oracle.checks_sql import with_findings

_RECORD = """
decided AS (
  SELECT finding_id, rule_id, CASE
    WHEN rule_id = 'AP-COM-003' AND substr(finding_id, 3, 1) < '2' THEN FALSE ELSE TRUE END AS ok
  FROM findings),
record AS (
  SELECT rule_id, count(*) AS cases, count(*) FILTER (ok) AS confirmed,
         count(*) >= 50 AND count(*) FILTER (ok) * 100 >= count(*) * 99 AS earned
  FROM decided GROUP BY rule_id)"""

_POINTS = """
once AS (
  SELECT DISTINCT bp_key, category, rule_id, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20
         WHEN 'medium' THEN 10 WHEN 'low' THEN 5 ELSE 0 END AS points FROM findings),
points AS (
  SELECT bp_key, category, least(sum(points), 100) AS points FROM once GROUP BY ALL),
every AS (
  SELECT bp_key, category, points FROM points
  UNION ALL SELECT bp_key, NULL, least(sum(points), 100) FROM points GROUP BY bp_key),
weight AS (
  SELECT bp_key, abs(open_items_local) + abs(volume_12m_local) + 1 AS w FROM bp_relevance)"""

_KIND = """
kinds AS (
  SELECT *, CASE WHEN rule_id IN ('AP-LEA-001', 'AP-LEA-002') THEN 'loss'
                 WHEN rule_id IN ('AR-CON-002', 'AR-VAL-003', 'AP-VAL-003') THEN 'exposure' END AS kind,
         CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
                       WHEN 'low' THEN 3 END AS worst
  FROM findings)"""

STATE_ORACLE = {
    "totals_by_kind": with_findings("""
SELECT kind, impact_currency AS currency, sum(impact_amount)::DECIMAL(25,2) AS amount
FROM kinds WHERE impact_amount IS NOT NULL GROUP BY ALL""", _KIND),
    "top_by_kind": with_findings("""
SELECT finding_id, rule_id, kind, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY impact_amount DESC, worst, finding_id)
    AS place FROM kinds WHERE impact_amount IS NOT NULL) WHERE place <= 10""", _KIND),
    "placed_findings": with_findings("""
SELECT finding_id, action_type, row_number() OVER (
  PARTITION BY action_type ORDER BY impact_amount DESC NULLS LAST, worst, finding_id) AS position
FROM kinds""", _KIND),
    "rule_automation": with_findings("SELECT * FROM record", _RECORD),
    "earned_tiers": with_findings("""
SELECT finding_id, f.rule_id, CASE WHEN damage_class <> 1 AND tier IN ('A', 'B')
         THEN CASE WHEN earned THEN 'A' ELSE 'B' END ELSE tier END AS tier
FROM findings f LEFT JOIN record USING (rule_id)""", _RECORD),
    "run_delta": with_findings("""
SELECT finding_id, rule_id,
       CASE WHEN d = '0' THEN 'new' WHEN d = 'f' THEN 'gone'
            WHEN d = '1' AND tier <> 'C' OR d = '2' AND impact_amount IS NOT NULL THEN 'changed'
            ELSE 'same' END AS change,
       CASE WHEN d = '1' AND tier <> 'C' THEN 'tier'
            WHEN d = '2' AND impact_amount IS NOT NULL THEN 'impact' END AS differs
FROM (SELECT *, substr(finding_id, 3, 1) AS d FROM findings)"""),
    "partner_scores": with_findings("""
SELECT bp_key, greatest(100 - sum(points), 0)::INTEGER AS score FROM points GROUP BY bp_key""",
                                    _POINTS),
    "category_scores": with_findings("""
SELECT category, count(*) AS partners,
       round(100 - sum(w * points)::DOUBLE / (SELECT sum(w) FROM weight)::DOUBLE, 4) AS score
FROM every JOIN weight USING (bp_key) GROUP BY category""", _POINTS),
    # exports in order of their names; a cleared item has a date and a document of its clearing
    "told_tables": """
WITH cleared AS (
  SELECT bool_or(o_orderstatus <> 'O' AND NOT o_orderkey % 50 = 7) AS ar FROM orders),
paid AS (
  SELECT bool_or(l_linestatus <> 'O' OR l_returnflag = 'R' AND l_quantity <= 5) AS ap FROM lineitem)
SELECT 'file-' || lpad(i::VARCHAR, 2, '0') AS file, CASE WHEN told = 'told' THEN name END AS "table",
       told AS outcome, fits::INTEGER AS fits
FROM (VALUES (0, 'ADR6', 'told', 1), (1, 'BSAD', 'ambiguous', 2), (2, 'BSAK', 'ambiguous', 2),
             (3, 'BSID', 'unknown', 0), (4, 'BSIK', 'unknown', 0), (5, 'KNA1', 'told', 1),
             (6, 'KNB1', 'told', 1), (7, 'KNB5', 'told', 1), (8, 'KNBK', 'told', 1),
             (9, 'KNVP', 'told', 2), (10, 'LFA1', 'told', 1), (11, 'LFB1', 'told', 1),
             (12, 'LFBK', 'told', 1), (13, 'T001', 'told', 1), (14, 'T052', 'told', 1),
             (15, 'T052U', 'told', 1), (16, 'TIBAN', 'told', 1)) t(i, name, told, fits),
     cleared, paid WHERE ar AND ap""",
}
