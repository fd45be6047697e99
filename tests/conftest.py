import datetime as dt
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgercheck.checks.contract import Model  # noqa: E402
from ledgercheck.operators.relevance import build_relevance  # noqa: E402
from ledgercheck.plans.run import Settler  # noqa: E402
from ledgercheck.schema import canonical_ddl  # noqa: E402
from ledgercheck.session import local_session, work_folder  # noqa: E402

AS_OF = dt.date(2026, 8, 28)
WINDOW_FROM = dt.date(2024, 9, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "ledgercheck-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settle(spark):
    return Settler(spark, work_folder(spark, "test"))


def partner(key, **given):
    row = dict(bp_key=key, role="CUSTOMER" if key[0] == "C" else "VENDOR", source_id=key[2:],
               is_one_time=False, deletion_flag=False, central_block=False, name1=f"Name {key}",
               city="Ort", country="DE", created_on=dt.date(2020, 1, 1))
    return {**row, **given}


_NUMBER = iter(range(1, 10**9))


def item(bp_key, **given):
    """A paid vendor invoice or an open customer invoice, unless told otherwise."""
    vendor = bp_key[0] == "V"
    number = f"{next(_NUMBER):010d}"
    row = dict(bp_key=bp_key, company_code="1000", fiscal_year="2026", document_no=number,
               line_item="001", posting_date=dt.date(2026, 3, 1), doc_type="KR" if vendor else "DR",
               debit_credit="H" if vendor else "S", currency="EUR", amount_doc="100.00",
               is_open=not vendor)
    row.update(given)
    from decimal import Decimal

    amount = Decimal(row["amount_doc"])
    signed = -amount if row["debit_credit"] == "H" else amount
    row.setdefault("item_key", "|".join((row["company_code"], row["fiscal_year"],
                                          row["document_no"], row["line_item"])))
    row.setdefault("document_date", row["posting_date"])
    row.update(amount_doc=amount, amount_local=amount, amount_signed_local=signed)
    if not row["is_open"]:
        row.setdefault("clearing_date", row["posting_date"])
    for name in ("cash_disc_pct1", "cash_disc_base", "cash_disc_taken"):
        if name in row:
            row[name] = Decimal(row[name])
    return row


def table(spark, name, rows):
    ddl = canonical_ddl(name)
    names = [part.split()[0] for part in ddl.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def make_model(spark, thresholds=None, as_of=AS_OF, **tables):
    """A model of hand-made rows; tables that are not given are empty."""
    names = ("company_code", "business_partner", "bp_tax_id", "bp_company_code",
             "bp_bank_account", "bp_partner_function", "payment_terms", "fi_item")
    given = dict(tables)
    given.setdefault("company_code", [dict(company_code="1000", currency="EUR")])
    frames = {n: table(spark, n, given.get(n, [])) for n in names}
    frames["bp_relevance"] = build_relevance(
        frames["business_partner"], frames["fi_item"], F.lit(as_of), F.lit("EUR"))
    return Model(frames, F.lit(as_of), F.lit(WINDOW_FROM), thresholds or {})
