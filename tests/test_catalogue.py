import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from conftest import item, make_model, partner

from ledgercheck.checks import catalogue


def keys(found, *columns):
    return sorted(tuple(r[c] for c in ("bp_key", *columns)) for r in found.collect())


def test_vat_missing(spark):
    model = make_model(
        spark, {"b2b_groups": ("B2B",)},
        business_partner=[
            partner("C:1", country="FR"), partner("C:2", country="FR"), partner("C:3"),
            partner("C:4", account_group="B2B"), partner("C:5", country="US"),
            partner("C:6", country=None), partner("C:7", country="AT", is_one_time=True),
            partner("C:8", country="GR"), partner("V:1", country="IT"),
            partner("V:2", account_group="B2B")],
        bp_tax_id=[dict(bp_key="C:1", tax_id_type="VAT", value="FR1", value_norm="FR1"),
                   dict(bp_key="C:2", tax_id_type="TAX1", value="1", value_norm="1"),
                   dict(bp_key="C:8", tax_id_type="VAT", value=" ", value_norm=" ")])
    assert keys(catalogue.vat_missing(model, "CUSTOMER")) == [("C:2",), ("C:4",), ("C:8",)]
    assert keys(catalogue.vat_missing(model, "VENDOR")) == [("V:1",)]


def test_bank_missing_by_method(spark):
    rows = [dict(bp_key=k, company_code="1000", payment_methods=m) for k, m in
            [("C:1", "L"), ("C:2", "SE"), ("C:3", "T"), ("C:4", None), ("V:1", "U"), ("V:2", "L")]]
    model = make_model(spark, business_partner=[partner(r["bp_key"]) for r in rows],
                       bp_company_code=rows,
                       bp_bank_account=[dict(bp_key="C:1", iban_norm="DE1", iban_valid=True)])
    assert keys(catalogue.bank_missing(model, "CUSTOMER"), "current_value") == [("C:2", "SE")]
    assert keys(catalogue.bank_missing(model, "VENDOR")) == [("V:1",)]


def test_dunning_only_of_active_customers(spark):
    rows = [dict(bp_key=k, company_code=c, dunning_procedure=d) for k, c, d in
            [("C:1", "1000", None), ("C:1", "2000", "0001"), ("C:2", "1000", " "),
             ("C:3", "1000", None)]]
    model = make_model(spark, {"dunning_procedure": "0002"},
                       business_partner=[partner(k) for k in ("C:1", "C:2", "C:3")],
                       bp_company_code=rows, fi_item=[item("C:1"), item("C:2")])
    found = catalogue.dunning_missing(model)
    assert keys(found, "company_code", "proposed_value", "tier") == [
        ("C:1", "1000", "0002", "A"), ("C:2", "1000", "0002", "A")]


@pytest.mark.parametrize("country, code, wrong", [
    ("DE", "01067", False), ("DE", " 01067 ", False), ("DE", "1067", True), ("AT", "1010", False),
    ("NL", "1011 AB", False), ("NL", "1011ab", True), ("PL", "00-950", False),
    ("GB", "SW1A 1AA", False), ("GB", "1AA", True), ("XX", "?", False), ("DE", None, False),
    ("DE", "", False), (None, "1", False), ("DE", "0" * 50000, True)])
def test_postal_code(spark, country, code, wrong):
    model = make_model(spark, business_partner=[partner("C:1", country=country, postal_code=code)])
    assert catalogue.postal_code(model).count() == wrong


@pytest.mark.parametrize("seed", range(3))
def test_terms_deviate_equals_brute_force(spark, seed):
    """A third of all invoices on one account, accounts at the very limit, null terms."""
    rng = random.Random(seed)
    names = [f"C:{i}" for i in range(12)]
    master = {n: rng.choice(["Z1", "Z2", "Z3", None]) for n in names} | {"C:0": "Z9", "C:1": "Z1"}
    invoices = [("C:0" if rng.random() < 0.34 else rng.choice(names[2:]),
                 rng.choice(["Z1", "Z2", "Z2", None])) for _ in range(150)]
    invoices += [("C:1", "Z2")] * 7 + [("C:1", "Z1")] * 3  # exactly 70 % is not more
    model = make_model(
        spark, business_partner=[partner(n) for n in names],
        bp_company_code=[dict(bp_key=n, company_code="1000", payment_terms=t)
                         for n, t in master.items()],
        fi_item=[item(k, payment_terms=t) for k, t in invoices])
    used = defaultdict(Counter)
    for k, t in invoices:
        if t:
            used[k][t] += 1
    expected = []
    for k, c in used.items():
        n, other = sum(c.values()), sum(v for t, v in c.items() if t != master[k])
        if master[k] and n >= 3 and other * 10 > n * 7:
            top = min(c, key=lambda t: (-c[t], t))
            expected.append((k, top, f"{other} von {n} Rechnungen mit anderer Zahlungsbedingung"))
    assert keys(catalogue.terms_deviate(model), "proposed_value", "current_display") \
        == sorted(expected)


def test_bank_abroad(spark):
    accounts = [("C:1", "FR7612", "1"), ("C:1", "DE12", "2"), ("C:2", None, "3"), ("C:3", "12", "4"),
                ("V:1", "AT12", "5"), ("C:4", "FR99", "6")]
    model = make_model(
        spark, business_partner=[partner("C:1"), partner("C:2"), partner("C:3"), partner("V:1"),
                                 partner("C:4", country=None)],
        bp_bank_account=[dict(bp_key=k, iban_norm=i, bank_key="B", account_number=a)
                         for k, i, a in accounts])
    assert keys(catalogue.bank_abroad(model, "CUSTOMER"), "finding_key") == [("C:1", "B|1")]
    assert keys(catalogue.bank_abroad(model, "VENDOR")) == [("V:1",)]


def test_shared_iban_of_customers(spark):
    """A hot IBAN, one with a payer link, one of a customer and a vendor, one of one-time accounts."""
    hot = [f"C:{i:04d}" for i in range(100, 400)]
    accounts = [(k, "DE11HOT") for k in hot] + [
        ("C:1", "DE22PAY"), ("C:2", "DE22PAY"), ("C:3", "DE33MIX"), ("V:3", "DE33MIX"),
        ("C:4", "DE44ONE"), ("C:5", "DE44ONE"), ("C:6", None), ("C:7", None), ("C:8", "DE55TWO"),
        ("C:8", "DE55TWO")]
    people = [partner(k, alt_payer_key="C:1" if k == "C:2" else None, is_one_time=k == "C:5")
              for k in {k for k, _ in accounts}]
    model = make_model(spark, business_partner=people, bp_bank_account=[
        dict(bp_key=k, iban_norm=i, bank_key="B", account_number="1") for k, i in accounts])
    found = catalogue.shared_iban_of_customers(model)
    assert keys(found, "current_display") == [
        ("C:0100", "bei 300 Debitorenkonten hinterlegt, ohne Regulierer-Bezug")]


def test_never_posted(spark):
    days = {"C:1": dt.date(2025, 1, 1), "C:2": dt.date(2026, 1, 1), "C:3": dt.date(2020, 1, 1),
            "C:4": None, "C:5": dt.date(2025, 1, 1), "C:6": dt.date(2025, 8, 28),
            "C:7": dt.date(2024, 9, 1)}
    model = make_model(spark, business_partner=[partner(k, created_on=d) for k, d in days.items()],
                       fi_item=[item("C:5")])
    assert keys(catalogue.never_posted(model)) == [("C:1",), ("C:7",)]


def test_late_discount(spark):
    day = dt.date(2026, 3, 1)

    def paid(after, taken="2.00", **given):
        return item("C:1", is_open=False, baseline_date=day, cash_disc_taken=taken,
                    clearing_date=day + dt.timedelta(after), **given)

    model = make_model(
        spark, business_partner=[partner("C:1")],
        payment_terms=[dict(terms_key="Z1", day_limit=20, days1=40),
                       dict(terms_key="Z1", day_limit=None, days1=10)],
        fi_item=[paid(15, cash_disc_days1=14), paid(14, cash_disc_days1=14),
                 paid(11, payment_terms="Z1"), paid(10, payment_terms="Z1"), paid(99),
                 paid(99, "0.00", cash_disc_days1=1), paid(99, cash_disc_days1=1, currency="USD"),
                 paid(99, cash_disc_days1=1, doc_type="DG")])
    assert keys(catalogue.late_discount(model), "company_code", "current_value") == [
        ("C:1", "1000", "4.00")]


def test_paid_though_blocked(spark):
    def payment(key, day=dt.date(2026, 3, 1), **given):
        return item(key, doc_type="KZ", debit_credit="S", posting_date=day, **given)

    model = make_model(
        spark, business_partner=[partner("V:1", central_block=True), partner("V:2"),
                                 partner("V:3", deletion_flag=True), partner("V:4")],
        bp_company_code=[dict(bp_key="V:2", company_code="1000", posting_block=True,
                              deletion_flag=False),
                         dict(bp_key="V:2", company_code="2000", posting_block=False,
                              deletion_flag=True)],
        company_code=[dict(company_code="1000", currency="EUR"),
                      dict(company_code="2000", currency="EUR")],
        fi_item=[payment("V:1"), payment("V:1"), payment("V:2"), payment("V:2", company_code="2000"),
                 payment("V:3", dt.date(2025, 8, 28)), payment("V:4"), item("V:1")])
    found = catalogue.paid_though_blocked(model)
    assert keys(found, "company_code", "source_table", "source_field", "impact_amount") == [
        ("V:1", "1000", "LFA1", "SPERR", 200), ("V:2", "1000", "LFB1", "SPERR", 100),
        ("V:2", "2000", "LFB1", "LOEVM", 100)]


def test_empty_tables(spark):
    model = make_model(spark)
    for check in (catalogue.dunning_missing, catalogue.postal_code, catalogue.terms_deviate,
                  catalogue.shared_iban_of_customers, catalogue.never_posted,
                  catalogue.late_discount, catalogue.paid_though_blocked):
        assert check(model).count() == 0
    for check in (catalogue.vat_missing, catalogue.bank_missing, catalogue.bank_abroad):
        assert check(model, "CUSTOMER").count() == 0 == check(model, "VENDOR").count()
