"""Customers that are vendors as well: the same VAT id or the same IBAN on both sides.

A value one third of all accounts share would pair every customer with every vendor.  Nothing
here does that.  The vendors a customer reaches are counted by inclusion and exclusion over the
sets of its values: how many vendors have all values of a set is one count per set, whatever the
number of accounts, so the work grows with the accounts.  Accounts of more than FEW_VALUES shared
values are paired with the other side one by one and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model, contract, params
from ledgercheck.checks.records import MEMBER_COLUMNS, value_key
from ledgercheck import fixed
from ledgercheck.functions.bank import iban_mask
from ledgercheck.functions.text import said
from ledgercheck.schema import EVIDENCE

_VAT, _BANK = "USt-IdNr.", "Bankverbindung"
_FIELD = {_VAT: "STCEG", _BANK: "IBAN"}


def account_values(model: Model) -> DataFrame:
    """VAT ids and IBANs of all accounts but one-time ones, once per account."""
    accounts = model["business_partner"].filter(~F.col("is_one_time")).select("bp_key", "role")
    vat = model["bp_tax_id"].filter("tax_id_type = 'VAT'").select(
        "bp_key", F.lit(_VAT).alias("criterion"), F.col("value_norm").alias("value"),
        F.lit("KNA1-STCEG / LFA1-STCEG").alias("reference"),
    )
    bank = model["bp_bank_account"].filter("iban_norm IS NOT NULL").select(
        "bp_key", F.lit(_BANK).alias("criterion"), F.col("iban_norm").alias("value"),
        F.concat(F.lit("TIBAN BANKL "), F.coalesce("bank_key", F.lit("–"))).alias("reference"),
    )
    return vat.unionByName(bank).distinct().join(accounts, "bp_key")


def shared_values(values: DataFrame) -> DataFrame:
    """Values customers and vendors have in common; min and max tell the two roles apart."""
    return (
        values.groupBy("criterion", "value")
        .agg(F.min("role").alias("low"), F.max("role").alias("high"))
        .filter("low <> high").select("criterion", "value")
    )


FEW_VALUES = 6   # an account of so many values has 63 sets of them


def _sets(accounts: DataFrame, *keep: str) -> DataFrame:
    """Every set (but the empty one) of an account's own values, in one row each."""
    return accounts.select(*keep, F.explode(F.expr(
        "transform(sequence(1, shiftleft(1, size(own)) - 1), "
        "m -> filter(own, (x, i) -> (shiftright(m, i) & 1) = 1))")).alias("part"))


def vendor_counts(values: DataFrame) -> DataFrame:
    """Per customer the number of vendors it shares a value with.

    `values` has the shared values of all accounts."""
    key = F.struct("criterion", "value")
    own = values.select("role", "bp_key", key.alias("v")).groupBy("role", "bp_key").agg(
        F.array_sort(F.collect_set("v")).alias("own"))
    few = own.filter(F.size("own") <= FEW_VALUES)

    def single(rows: DataFrame) -> DataFrame:
        return rows.select("role", "bp_key", F.explode("own").alias("v"))

    many, rest, accounts = (single(x) for x in (own.filter(F.size("own") > FEW_VALUES), few, own))

    customers = few.filter("role = 'CUSTOMER'").select("bp_key", "own")
    holders = _sets(few.filter("role = 'VENDOR'")).groupBy("part").agg(F.count("*").alias("n"))
    # accounts with the same values are counted once
    kinds = _sets(customers.select("own").distinct(), "own").join(holders, "part").groupBy("own").agg(
        F.sum(F.when(F.size("part") % 2 == 1, F.col("n")).otherwise(-F.col("n"))).alias("n"))
    counted = customers.join(kinds, "own").select("bp_key", "n")

    def paired(one: DataFrame, other: DataFrame) -> DataFrame:
        return one.filter("role = 'CUSTOMER'").select("bp_key", "v").join(
            other.filter("role = 'VENDOR'").select(F.col("bp_key").alias("vendor"), "v"), "v") \
            .select("bp_key", "vendor").distinct().groupBy("bp_key").agg(F.count("*").alias("n"))

    return counted.union(paired(rest, many)).union(paired(many, accounts)).groupBy("bp_key").agg(
        F.sum("n").alias("vendors"))


def cross_role_values(model: Model) -> DataFrame:
    """One row per shared value, with the number of accounts on either side."""
    values = account_values(model)
    accounts = values.select("criterion", "value", "role", "bp_key").distinct()
    counts = accounts.groupBy("criterion", "value").agg(
        F.count(F.when(F.col("role") == "CUSTOMER", 1)).alias("customers"),
        F.count(F.when(F.col("role") == "VENDOR", 1)).alias("vendors"),
    )
    return counts.filter("customers > 0 AND vendors > 0").withColumn(
        "value", _shown(F.col("criterion"), F.col("value"))
    )


def _shown(criterion, value):
    return F.when(criterion == _BANK, iban_mask(value)).otherwise(value)


def customer_is_vendor(model: Model) -> DataFrame:
    """One finding per customer that shares a value with at least one vendor; the accounts of
    its values are in `cross_role_members`."""
    values = account_values(model)
    values = values.join(shared_values(values), ["criterion", "value"], "left_semi")
    entry = F.struct(
        F.col("criterion"), _shown(F.col("criterion"), F.col("value")).alias("value"),
        F.col("reference"),
    )
    hits = values.filter("role = 'CUSTOMER'").groupBy("bp_key").agg(
        F.array_sort(F.collect_set(entry)).alias("hits")
    )
    found = vendor_counts(values).join(hits, "bp_key")

    def distinct(name: str):
        return F.array_sort(F.array_distinct(F.transform("hits", lambda h: h[name])))

    criteria, shown = F.array_join(distinct("criterion"), " und "), F.array_join(
        distinct("value"), " / ")
    fields = F.array_sort(F.transform(
        distinct("criterion"), lambda c: F.when(c == _BANK, F.lit(_FIELD[_BANK]))
        .otherwise(F.lit(_FIELD[_VAT]))))
    return contract(
        found, bp_key=F.col("bp_key"), role="CUSTOMER", source_table="KNA1 + LFA1",
        source_field=F.array_join(fields, " + "), current_value=shown,
        current_display=said(fixed.CROSS_ROLE, criteria=criteria),
        proposed_display=fixed.CROSS_ROLE_PROPOSAL,
        source_summary=said(
            fixed.CROSS_ROLE_SUMMARY, criteria=criteria,
            vendors=F.when(F.col("vendors") == 1, F.lit(fixed.ONE_VENDOR))
            .otherwise(said(fixed.SOME_VENDORS, n=F.col("vendors")))),
        evidence=F.transform("hits", lambda h: F.struct(
            F.lit("deterministic").alias("source_type"), h["reference"].alias("reference"),
            F.lit("master_field").alias("reference_kind"), h["value"].alias("value"),
            F.lit(None).cast("string").alias("observed_at"), F.lit(True).alias("agrees"),
            said(fixed.CROSS_ROLE_NOTE, criterion=h["criterion"]).alias("note"),
        ).cast(EVIDENCE)),
        params=params(match_label=criteria, match_value=shown, kreditoren=F.col("vendors")),
    )


def cross_role_members(model: Model) -> DataFrame:
    """Every account of every shared value, one row each: the whole of what is matched."""
    values = account_values(model)
    shared = shared_values(values)
    return values.join(shared, ["criterion", "value"], "left_semi").select(
        "criterion", _shown(F.col("criterion"), F.col("value")).alias("value"), "role", "bp_key"
    )


def matched_members(model: Model) -> DataFrame:
    """The accounts of every shared value, customers and vendors, one row each."""
    values = account_values(model)
    return values.join(shared_values(values), ["criterion", "value"], "left_semi").select(
        F.lit("CROSS-DUP-001").alias("rule_id"),
        value_key(F.col("criterion"), F.col("value")).alias("value_key"),
        _shown(F.col("criterion"), F.col("value")).alias("shown"), "role", "bp_key",
    ).select(*MEMBER_COLUMNS).distinct()


def matched_values(model: Model, found: DataFrame) -> DataFrame:
    """The shared values of each finding; its customer stands beside the vendors of them."""
    customers = matched_members(model).filter("role = 'CUSTOMER'")
    masked = F.when(F.col("shown").contains(" … "), F.col("shown"))
    return found.filter("rule_id = 'CROSS-DUP-001'").select(
        "finding_id", F.col("entity.bp_key").alias("bp_key")).join(customers, "bp_key").select(
        "finding_id", "value_key", F.col("bp_key").alias("own_key"), masked.alias("iban_masked"))
