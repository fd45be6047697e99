import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import rows_of
from ledgercheck.plans.catalog import QUERIES as CATALOG

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
# one query per stage; check_oracle.py runs all of them
SOME = ["parse_amount", "control_totals", "canonical_fi_item", "canonical_rejects", "conservation",
        "partner_relevance", "check_ap_lea_001", "check_ap_lea_002", "check_ar_com_002",
        "check_cross_dup_001", "all_checks", "memory_applied", "record_comparison",
        "finding_sample", "compare_runs", "normalised_partners", "match_pairs", "match_clusters",
        "golden_records", "check_ar_dup_001", "check_ap_lea_001_duplicates", "payments_after_change",
        "check_ap_lea_003", "rebookings", "check_cross_lea_001", "rule_automation", "run_delta",
        "category_scores", "told_tables", "totals_by_kind", "placed_findings", "check_ar_con_001",
        "check_ar_con_004", "check_ar_lea_003", "check_ap_con_003"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    result = con.execute(entry_points.oracle_sql()[name])
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_every_oracle_belongs_to_a_query():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries)
    ours = {n for n in queries if n in CATALOG}
    assert ours - set(oracle) == {"file_hashes", "header_check"}


def test_statements_work_out_each_table_once():
    sql = entry_points.oracle_sql()
    assert "\nfindings AS MATERIALIZED (" in sql["all_checks"]
    assert "\nfi_item AS MATERIALIZED (" in sql["all_checks"]
    assert "fi_item" not in sql["canonical_business_partner"]
