import datetime as dt
import itertools
import random
from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, item, make_model, partner

from ledgercheck.checks import (
    bank_data,
    cross_role,
    double_payment,
    duplicates,
    items,
    master_data,
)
from ledgercheck.checks.rules import RULE_BY_ID, RULES
from ledgercheck.operators import explore, findings, report
from ledgercheck.plans import derived
from ledgercheck.plans.catalog import QUERIES
from ledgercheck.plans.run import check_all

DAY = dt.date(2026, 3, 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_double_payment_against_brute_force(spark):
    """One vendor and amount hold most invoices; every pair is found, and once."""
    rng = random.Random(7)
    rows = []
    for n in range(220):
        hot = n % 3 > 0
        rows.append(item(
            "V:1" if hot else f"V:{n % 5}", amount_doc="50.00" if hot else f"{n % 4}.00",
            posting_date=DAY + dt.timedelta(days=rng.randrange(400)),
            reference_norm="".join(rng.choice("12") for _ in range(rng.randrange(0, 6)))))
        rows[-1]["reference"] = rows[-1]["reference_norm"]
    for n in range(25):
        rows.append(item("V:1", doc_type=rng.choice(["KG", "KZ"]), debit_credit="S",
                         amount_doc="50.00", posting_date=DAY + dt.timedelta(days=n * 40)))
    model = make_model(spark, business_partner=[partner(f"V:{i}") for i in range(5)], fi_item=rows)
    expected = {}
    invoices = [r for r in rows if r["doc_type"] == "KR"]
    credits = [r for r in rows if r["doc_type"] == "KG"]
    for late in invoices:
        near, others = [], 0
        if any(g["bp_key"] == late["bp_key"] and g["amount_doc"] == late["amount_doc"]
               and 0 <= (g["document_date"] - late["document_date"]).days <= 180 for g in credits):
            continue
        for other in invoices:
            gap = (late["document_date"] - other["document_date"]).days
            if (other is not late and 0 <= gap <= 60
                    and all(late[c] == other[c] for c in ("bp_key", "currency", "amount_doc"))
                    and distance(late["reference_norm"], other["reference_norm"]) <= 1):
                others += 1
                if gap or other["item_key"] < late["item_key"]:
                    near.append((gap, other["item_key"], other))
        if near:
            pair = sorted((late, min(near)[2]), key=lambda r: r["item_key"])
            expected["|".join(r["document_no"] for r in pair), late["document_no"]] = others
    found = double_payment.double_payment(model).collect()
    assert sorted(r.finding_key for r in found) == sorted(k for k, _ in expected)
    assert len(expected) > 10 and max(expected.values()) > 5
    counts = double_payment.nearest_matches(double_payment.not_netted(
        double_payment.repeated_amounts(double_payment.paid_invoices(model)), model)).collect()
    counts = {r.item_key.split("|")[2]: r.matches for r in counts}
    assert all(counts[late] == n for (_, late), n in expected.items())


def test_equal_invoices_are_not_paired_off(spark):
    rows = [item("V:1", amount_doc="50.00", posting_date=DAY, reference_norm="A1", reference="A1")
            for _ in range(400)]
    model = make_model(spark, business_partner=[partner("V:1")], fi_item=rows)
    found = double_payment.double_payment(model).collect()
    assert len(found) == 399 and "399 passende Belege" in found[0].source_summary


def test_cross_role_against_brute_force(spark):
    """A VAT id most accounts share, and some IBANs on top of it."""
    rng = random.Random(3)
    partners, vat, banks = [], [], []
    for i in range(60):
        key = f"{'C' if i % 2 else 'V'}:{i}"
        partners.append(partner(key, is_one_time=i % 17 == 0))
        vat.append(dict(bp_key=key, tax_id_type="VAT", value="x", value_norm="HOT" if i % 3 else f"N{i}"))
        for n in range(rng.randrange(3)):
            banks.append(dict(bp_key=key, bank_key=f"B{n}", iban_norm=f"DE{rng.randrange(12):04d}X1234"))
    model = make_model(spark, business_partner=partners, bp_tax_id=vat, bp_bank_account=banks)
    good = {p["bp_key"] for p in partners if not p["is_one_time"]}
    values = {}
    for row in [*vat, *banks]:
        if row["bp_key"] in good:
            value = row.get("value_norm") or row["iban_norm"]
            values.setdefault(value, set()).add(row["bp_key"])
    expected = {}
    for keys in values.values():
        for c in keys:
            vendors = {v for v in keys if v[0] == "V"}
            if c[0] == "C" and vendors:
                expected.setdefault(c, set()).update(vendors)
    found = {r.bp_key: r for r in cross_role.customer_is_vendor(model).collect()}
    members = {}
    for r in cross_role.matched_members(model).collect():
        members.setdefault(r.value_key, set()).add(r.bp_key)
    both_sides = [k for k in values.values() if len({b[0] for b in k}) == 2]
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, both_sides))
    assert {k: int(r.params["kreditoren"]) for k, r in found.items()} == {
        k: len(v) for k, v in expected.items()}


def test_hot_value_costs_its_accounts_not_their_pairs(spark):
    """200 customers and 200 vendors share one VAT id, and each has one more shared value."""
    partners = [partner(f"{s}:{i}") for s in "CV" for i in range(200)]
    vat = [dict(bp_key=p["bp_key"], tax_id_type="VAT", value="x", value_norm="HOT") for p in partners]
    banks = [dict(bp_key=p["bp_key"], bank_key="B", iban_norm=f"DE{int(p['source_id']):04d}X1234")
             for p in partners]
    model = make_model(spark, business_partner=partners, bp_tax_id=vat, bp_bank_account=banks)
    found = cross_role.customer_is_vendor(model).collect()
    assert len(found) == 200 and {int(r.params["kreditoren"]) for r in found} == {200}
    assert cross_role.matched_members(model).count() == 800


def test_two_hot_values_pair_no_classes(spark):
    """200 customers and 200 vendors share a VAT id and an IBAN, each has one more shared value;
    some accounts have more shared values than sets are made of."""
    partners = [partner(f"{s}:{i}") for s in "CV" for i in range(200)]
    vat = [dict(bp_key=p["bp_key"], tax_id_type="VAT", value="x", value_norm="HOT") for p in partners]
    banks = [dict(bp_key=p["bp_key"], bank_key="B", iban_norm=iban) for p in partners
             for iban in ["DEHOT", f"DE{int(p['source_id']):04d}X1234",
                          *([f"DEW{n}" for n in range(9)] if p["source_id"] in ("7", "8") else [])]]
    lone = [partner("C:900"), partner("V:900")]
    vat += [dict(bp_key=p["bp_key"], tax_id_type="VAT", value="y", value_norm="LONE") for p in lone]
    model = make_model(spark, business_partner=partners + lone, bp_tax_id=vat, bp_bank_account=banks)
    values = cross_role.account_values(model)
    counted = cross_role.vendor_counts(values)
    assert {r.bp_key: r.vendors for r in counted.collect()} == {
        **{f"C:{i}": 200 for i in range(200)}, "C:900": 1}


def test_a_large_cluster_is_shown_whole(spark):
    model = make_model(
        spark, business_partner=[partner(f"V:{i}", city="Ulm" if i == 7 else "Ort")
                                 for i in range(1500)],
        bp_bank_account=[dict(bp_key=f"V:{i}", iban_norm="DE00A1234") for i in range(1500)])
    finding = bank_data.shared_iban(model).first()
    assert finding.params["konten"] == "1500" and finding.related_bp_keys is None
    assert bank_data.cluster_members(model).count() == 1500
    found = spark.createDataFrame(
        [("F", "AP-CON-001", (finding.bp_key,), (finding.current_value,))],
        "finding_id string, rule_id string, entity struct<bp_key:string>, current struct<value:string>")
    rows = {r.field: r for r in explore.record_comparison(model, found).collect()}
    assert rows["city"].differs and (rows["city"].low, rows["city"].high) == ("Ort", "Ulm")
    assert not rows["country"].differs and rows["vat_id"].missing


def test_shared_iban_and_payer_links(spark):
    account = [("V:1", "A"), ("V:2", "A"), ("V:3", "B"), ("V:4", "B"), ("V:5", "C"), ("V:6", "C"),
               ("V:7", "D"), ("V:8", "E"), ("V:9", "E"), ("V:9", "E"), ("C:1", "D")]
    model = make_model(
        spark,
        business_partner=[partner(f"V:{i}", alt_payer_key="V:3" if i == 4 else None,
                                  is_one_time=i == 9) for i in range(1, 10)] + [partner("C:1")],
        bp_company_code=[dict(bp_key="V:5", company_code="1000", alt_payer_key="V:6")],
        bp_bank_account=[dict(bp_key=k, iban_norm=f"DE00{i}1234") for k, i in account])
    found = bank_data.shared_iban(model).collect()
    # A is left: B and C have a payer, D has one vendor, and V:9 is a one-time account
    assert [r.bp_key for r in found] == ["V:1"]
    assert {r.bp_key for r in bank_data.cluster_members(model).collect()} == {"V:1", "V:2"}
    assert "DE00A1234" not in str(found)


def test_terms_majority(spark):
    def invoices(key, *terms):
        return [item(key, payment_terms=t) for t in terms]

    model = make_model(
        spark, business_partner=[partner(f"C:{i}") for i in range(1, 6)],
        bp_company_code=[dict(bp_key=f"C:{i}", company_code="1000") for i in range(1, 6)],
        payment_terms=[dict(terms_key="A", day_limit=9, description="spät"),
                       dict(terms_key="A", description="ohne Grenze")],
        fi_item=[*invoices("C:1", "A", "A", "A", "B", "C"), *invoices("C:2", "A", "A"),
                 *invoices("C:3", "A", "A", "B", "B"), *invoices("C:4", "A", "A", "A", None)])
    found = {r.bp_key: r for r in master_data.terms_missing(model).collect()}
    assert {k: (r.tier, r.proposed_value) for k, r in found.items()} == {
        "C:1": ("B", "A"), "C:2": ("C", None), "C:3": ("C", None), "C:4": ("B", "A"),
        "C:5": ("C", None)}
    assert found["C:1"].proposed_display == "ohne Grenze"


def test_unapplied_cash(spark):
    def payment(key, days, **given):
        return item(key, doc_type="DZ", debit_credit="H", is_open=True,
                    posting_date=AS_OF - dt.timedelta(days=days), **given)

    model = make_model(
        spark, business_partner=[partner("C:1"), partner("C:2")],
        fi_item=[payment("C:1", 31), payment("C:1", 30), payment("C:1", 40, reference_norm=""),
                 payment("C:1", 40, special_gl="A"), payment("C:2", 90, assignment="x"),
                 payment("C:2", 90), item("C:1", amount_doc="12.50")])
    found = items.unapplied_cash(model).orderBy("bp_key").collect()
    assert [r.bp_key for r in found] == ["C:1", "C:2"]
    assert found[0].proposed_display.startswith("Zahlung") and "12,50 EUR" in found[0].source_summary
    assert found[1].proposed_display.startswith("Keine offene Rechnung")


def test_lost_discount_buckets(spark):
    def invoice(paid_after, **given):
        day = AS_OF - dt.timedelta(days=100)
        row = dict(posting_date=day, baseline_date=day, cash_disc_days1=14, cash_disc_pct1="2.000",
                   cash_disc_base="40000.00", payment_terms="Z", amount_doc="40000.00")
        if paid_after is not None:
            row["clearing_date"] = day + dt.timedelta(days=paid_after)
        return item("V:1", **{**row, **given})

    recent = AS_OF - dt.timedelta(days=14)
    model = make_model(
        spark, business_partner=[partner("V:1")],
        fi_item=[invoice(15), invoice(20), invoice(14), invoice(30, cash_disc_taken="1.00"),
                 invoice(None, is_open=True), invoice(20, currency="USD"),
                 invoice(None, is_open=True, posting_date=recent, baseline_date=recent),
                 invoice(20, posting_date=AS_OF.replace(year=2025))])
    row = items.discount_buckets(model).first()
    assert (row.invoices, row.late, str(row.loss), row.foreign_invoices) == (6, 2, "1600.00", 1)
    assert (row.n_expired, row.n_running, row.first_day, row.last_day) == (1, 1, 15, 20)
    assert items.lost_discount(model).count() == 1
    model.thresholds["min_loss"] = "1600.01"
    assert items.lost_discount(model).count() == 0


def test_relevance_window_is_open_on_the_left(spark):
    start = AS_OF.replace(year=2025)
    model = make_model(
        spark, business_partner=[partner("C:1"), partner("V:1"), partner("C:2"),
                                 partner("C:3", created_on=AS_OF)],
        fi_item=[item("C:1", posting_date=start, amount_doc="1.00"),
                 item("C:1", posting_date=start + dt.timedelta(days=1), amount_doc="2.00"),
                 item("C:1", posting_date=AS_OF, amount_doc="4.00", doc_type="DG", debit_credit="H"),
                 item("C:1", posting_date=AS_OF + dt.timedelta(days=1), amount_doc="8.00"),
                 item("V:1", posting_date=AS_OF, amount_doc="16.00",
                      clearing_date=AS_OF + dt.timedelta(days=5)),
                 item("C:2", posting_date=start)])
    found = {r.bp_key: r for r in model["bp_relevance"].collect()}
    assert str(found["C:1"].volume_12m_local) == "-2.00"
    assert str(found["C:1"].open_items_local) == "7.00"
    assert str(found["V:1"].volume_12m_local) == "16.00"
    assert found["V:1"].last_activity_on == AS_OF
    assert [found[k].activity_status for k in ("C:1", "C:2", "C:3")] == [
        "active", "dormant", "never_posted"]


def test_blocked_unused_and_unchecked_accounts(spark):
    model = make_model(
        spark, business_partner=[partner("C:1", central_block=True), partner("C:2"), partner("V:1"),
                                 partner("C:3", created_on=None), partner("C:4", is_one_time=True)],
        bp_company_code=[dict(bp_key="C:1", company_code="1000", posting_block=False,
                              deletion_flag=True),
                         dict(bp_key="V:1", company_code="1000", double_invoice_check=False)],
        fi_item=[item("C:1", amount_doc="5.00")])
    blocked = master_data.blocked_with_open_items(model).first()
    assert (blocked.source_table, blocked.source_field) == ("KNA1", "SPERR")
    assert len(blocked.options) == 2 and str(blocked.impact_amount) == "5.00"
    assert {r.bp_key for r in master_data.unused_account(model, "CUSTOMER").collect()} == {
        "C:2", "C:3"}
    assert master_data.invoice_check_off(model).first().source_summary.startswith("0 von 1 ")


def test_a_rule_without_its_tables_is_skipped_and_one_that_fails_is_told(spark, settle):
    model = make_model(spark, business_partner=[partner("C:1")])
    del model.tables["payment_terms"]

    def planned(_):
        raise KeyError("no such column")

    def running(part):
        return RULE_BY_ID["AR-HYG-001"].check(part).withColumn(
            "current_value", F.raise_error(F.lit("broken")).cast("string"))

    broken = {"AP-VAL-001": planned, "AR-HYG-001": running}
    rules = [replace(r, check=broken.get(r.id, r.check)) for r in RULES]
    found, told = check_all(model, findings.RunContext("r", "t"), settle, rules)
    assert set(told.skipped) == {"AR-COM-002", "AP-LEA-002"} and set(told.failed) == set(broken)
    assert len(told.executed) == 13 and found.count() == 0
    rows = {r.rule_id: r.status for r in report.rule_outcomes(found, told).collect()}
    assert rows["AR-HYG-001"] == "failed" and rows["AP-LEA-002"] == "skipped"
    assert findings.no_hits(model).count() == 0


def test_a_lost_executor_is_no_failed_check(spark):
    def lost(model):
        raise RuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited)")

    rule = replace(RULES[0], check=lost, requires=())
    with pytest.raises(RuntimeError, match="ExecutorLostFailure"):
        findings.run_rules(make_model(spark), [rule], lambda name, df: None)


@pytest.mark.parametrize("query", ["overview", "decision_import_missing"])
def test_a_failed_check_is_no_result_of_a_query(spark, monkeypatch, query):
    """Neither counts nor lists of findings hide that a check failed or was skipped."""
    def broken(part):
        return RULE_BY_ID["AR-HYG-001"].check(part).withColumn(
            "current_value", F.raise_error(F.lit("broken")).cast("string"))

    built = {k: v for k, v in derived._BUILT.items() if k[2] != "findings"}
    monkeypatch.setattr(derived, "_BUILT", built)
    rules = [replace(RULE_BY_ID["AR-HYG-001"], check=broken),
             replace(RULE_BY_ID["AP-LEA-002"], requires=("no_such_table",))]
    monkeypatch.setattr(derived, "check_all", partial(check_all, rules=rules))
    with pytest.raises(ValueError, match="AP-LEA-002 skipped.*no_such_table.*AR-HYG-001 failed"):
        QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    assert not any(k[2] == "findings" for k in built)


def test_a_broadcast_that_breaks_off_is_no_failed_check(spark):
    def late(model):
        raise RuntimeError("Could not execute broadcast in 300 secs.")

    rule = replace(RULES[0], check=late, requires=())
    with pytest.raises(RuntimeError, match="broadcast"):
        findings.run_rules(make_model(spark), [rule], lambda name, df: None)


def test_invoices_that_may_pair_are_written_once_and_read_with_their_account(spark, settle):
    rows = [item(v, amount_doc="50.00", reference_norm="R1", reference="R1", document_no=f"{i:010d}")
            for i, v in enumerate(("V:1", "V:2", "V:1", "V:3"))]
    model = make_model(spark, business_partner=[partner(f"V:{i}") for i in (1, 2, 3)], fi_item=rows)
    made, asked = [], []

    class Noted(dict):
        def __getitem__(self, name):
            asked.append(name)
            return super().__getitem__(name)

    def noted(df, name):
        made.append(name)
        return settle(df, f"{name}-{len(made)}")

    model = replace(model, tables=Noted(model.tables), settle=noted)
    assert [r.finding_key for r in double_payment.double_payment(model).collect()] == [
        "0000000000|0000000002"]
    assert made == ["paid-invoices"]
    asked.clear()
    members = spark.createDataFrame([("V:1", "V:1"), ("V:2", "V:1")], "bp_key string, cluster_id string")
    found = duplicates.paid_on_two_accounts(model, members)
    assert made == ["paid-invoices"] * 2 and asked.count("fi_item") == 1
    assert [(r.bp_key, r.related_bp_keys) for r in found.collect()] == [("V:1", ["V:2"])]


def test_small_and_large_groups_of_invoices_have_the_same_matches(spark):
    """Compared one by one and by keys; only large groups make keys."""
    rng = random.Random(11)
    rows = [item("V:1", amount_doc="50.00", posting_date=DAY + dt.timedelta(days=rng.randrange(300)),
                 reference_norm="".join(rng.choice("12") for _ in range(rng.randrange(0, 5))))
            for _ in range(double_payment.SMALL_GROUP)]
    model = make_model(spark, business_partner=[partner("V:1")], fi_item=rows)
    invoices = double_payment.repeated_amounts(double_payment.paid_invoices(model))
    one_by_one = double_payment.matches_one_by_one(invoices)
    by_keys = double_payment.matches_by_keys(invoices)
    assert sorted(map(tuple, one_by_one.collect())) == sorted(map(tuple, by_keys.collect()))
    assert one_by_one.count() > 30
    assert {r.in_group for r in invoices.select("in_group").distinct().collect()} == {
        double_payment.SMALL_GROUP}
    assert "explode" not in one_by_one._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, double_payment.nearest_matches(invoices).collect())) == sorted(
        map(tuple, one_by_one.collect()))
