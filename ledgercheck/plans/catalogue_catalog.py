"""Queries of the catalogue checks beside the client's 17.

All run over every partner and item of the derived client, whose master data gets gaps by formula:
missing VAT ids and bank accounts, payment methods, shared and foreign IBANs, terms nobody uses,
cash discount on customer invoices.  The formulas stand in the oracle too.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgercheck.checks import catalogue
from ledgercheck.checks.contract import Model
from ledgercheck.plans import derived
from ledgercheck.plans.catalog import flat, query
from ledgercheck.schema import MONEY
from ledgercheck.session import Stages

_K = "CAST(substring(bp_key, 3) AS BIGINT)"
_CUSTOMER = "bp_key LIKE 'C:%'"


def gaps(spark: SparkSession, sf_dir: str) -> Model:
    model = derived.model(spark, sf_dir)
    shared = f"concat('AT', lpad(CAST({_K} DIV 40 AS STRING), 18, '0'))"
    changed = {
        "bp_company_code": lambda rows: rows.withColumns({
            "payment_methods": F.expr(f"CASE {_K} % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'T' "
                                      "WHEN 2 THEN 'L' END"),
            "dunning_procedure": F.expr(f"CASE WHEN {_K} % 9 <> 2 THEN '0001' END"),
            "payment_terms": F.expr(f"CASE WHEN {_CUSTOMER} AND {_K} % 7 = 0 THEN 'ZB09' "
                                    "ELSE payment_terms END")}),
        "bp_tax_id": lambda rows: rows.where(f"tax_id_type <> 'VAT' OR {_K} % 17 <> 0"),
        "bp_bank_account": lambda rows: rows.where(f"{_K} % 13 <> 0").withColumn(
            "iban_norm", F.expr(f"CASE WHEN {_CUSTOMER} AND {_K} % 20 IN (6, 16) THEN {shared} "
                                "ELSE iban_norm END")),
        "fi_item": lambda rows: rows.withColumn("cash_disc_taken", F.expr(
            f"CASE WHEN {_CUSTOMER} AND CAST(document_no AS BIGINT) % 7 = 0 "
            "THEN round(amount_local * 0.02, 2) ELSE cash_disc_taken END").cast(MONEY)),
    }
    return model.having(Stages(changed, lambda name: changed[name](model[name])))


CHECKS: dict[str, Callable] = {
    "AR-COM-001": lambda m: catalogue.vat_missing(m, "CUSTOMER"),
    "AP-COM-001": lambda m: catalogue.vat_missing(m, "VENDOR"),
    "AR-COM-003": lambda m: catalogue.bank_missing(m, "CUSTOMER"),
    "AP-COM-002": lambda m: catalogue.bank_missing(m, "VENDOR"),
    "AR-COM-004": catalogue.dunning_missing,
    "AR-VAL-004": catalogue.postal_code,
    "AR-CON-001": catalogue.terms_deviate,
    "AR-CON-003": lambda m: catalogue.bank_abroad(m, "CUSTOMER"),
    "AP-CON-002": lambda m: catalogue.bank_abroad(m, "VENDOR"),
    "AR-CON-004": catalogue.shared_iban_of_customers,
    "AR-HYG-002": catalogue.never_posted,
    "AR-LEA-003": catalogue.late_discount,
    "AP-CON-003": catalogue.paid_though_blocked,
}


def _register(rule_id: str, check: Callable) -> None:
    def found(spark, sf_dir):
        return flat(check(gaps(spark, sf_dir)))

    found.__name__ = "check_" + rule_id.lower().replace("-", "_")
    query(found)


for _id, _check in CHECKS.items():
    _register(_id, _check)
