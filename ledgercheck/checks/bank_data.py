"""Bank data: IBANs that cannot be right, and IBANs several vendors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model, contract, evidence, params
from ledgercheck.checks.records import MEMBER_COLUMNS, value_key
from ledgercheck import fixed
from ledgercheck.functions import numbers
from ledgercheck.functions.bank import iban_mask
from ledgercheck.functions.text import said


def _bank_reference() -> Column:
    dash = F.lit("–")
    return said(fixed.IBAN_REFERENCE, bank_key=F.coalesce("bank_key", dash),
                bank_type=F.coalesce("partner_bank_type", dash))


def invalid_iban(model: Model, role: str) -> DataFrame:
    """The IBAN fails its check digits; what is open on the partner is at stake."""
    relevance = model["bp_relevance"].select("bp_key", "open_items_local", "currency")
    found = (
        model["bp_bank_account"].filter(~F.col("iban_valid"))
        .select("bp_key", "bank_key", "partner_bank_type", "iban_norm")
        .join(model.partners(role, "role"), "bp_key")
        .join(relevance, "bp_key", "left")
        .withColumn("masked", iban_mask(F.col("iban_norm")))
    )
    at_stake = F.col("open_items_local") > 0
    return contract(
        found, bp_key=F.col("bp_key"), role=F.col("role"), source_table="TIBAN",
        source_field="IBAN", current_value=F.col("masked"),
        current_display=fixed.IBAN_WRONG,
        evidence=F.array(evidence(
            "iban_checksum", _bank_reference(), F.col("masked"), False,
            fixed.IBAN_WRONG_NOTE)),
        impact_amount=F.when(at_stake, F.col("open_items_local")),
        impact_currency=F.when(at_stake, F.col("currency")),
        impact_formula=F.when(at_stake, said(
            fixed.OPEN_ITEMS_AT_STAKE[role],
            money=numbers.money(F.col("open_items_local"), F.col("currency")))),
        params=params(iban_masked=F.col("masked"), bank_key=F.col("bank_key"),
                      partner_bank_type=F.col("partner_bank_type")),
    )


def shared_iban_members(model: Model, role: str = "VENDOR") -> DataFrame:
    """Partners that share an IBAN: one row per IBAN and partner, of IBANs with several."""
    accounts = (
        model["bp_bank_account"].filter(F.col("iban_norm").isNotNull())
        .join(model.partners(role), "bp_key", "left_semi")
        .groupBy("iban_norm", "bp_key")
        .agg(F.min("bank_key").alias("bank_key"),
             F.min("partner_bank_type").alias("partner_bank_type"))
    )
    # min and max differ exactly when there are two, and both shrink on the map side
    shared = accounts.groupBy("iban_norm").agg(
        F.min("bp_key").alias("first"), F.max("bp_key").alias("last")
    ).filter(F.col("first") != F.col("last")).select("iban_norm")
    return accounts.join(shared, "iban_norm", "left_semi")


def payer_links(model: Model) -> DataFrame:
    """Pairs of different partners tied by an alternative payer or a partner role."""
    sources = [
        ("business_partner", "alt_payer_key"), ("bp_company_code", "alt_payer_key"),
        ("bp_partner_function", "partner_bp_key"),
    ]
    parts = [
        model[t].select("bp_key", F.col(c).alias("other")).filter(F.col("bp_key") != F.col("other"))
        for t, c in sources
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def shared_iban_clusters(model: Model, role: str = "VENDOR") -> DataFrame:
    """One row per IBAN of several partners none of which pays for another.

    A link is looked up from its two ends: first the IBANs of the one partner, then
    whether the other partner has the same.  Members are never paired with each other.
    """
    members = shared_iban_members(model, role)
    ends = members.select("iban_norm", "bp_key")
    linked = (
        ends.join(payer_links(model), "bp_key")
        .select("iban_norm", F.col("other").alias("bp_key"))
        .join(ends, ["iban_norm", "bp_key"], "left_semi")
        .select("iban_norm").distinct()
    )
    return (
        members.groupBy("iban_norm").agg(
            F.min("bp_key").alias("anchor"), F.count("*").alias("accounts"),
            F.min("bank_key").alias("bank_key"),
            F.min("partner_bank_type").alias("partner_bank_type"))
        .join(linked, "iban_norm", "left_anti")
    )


def cluster_members(model: Model) -> DataFrame:
    """Every account of every cluster, one row each."""
    members = shared_iban_members(model).join(
        shared_iban_clusters(model).select("iban_norm"), "iban_norm", "left_semi")
    return members.select(
        F.lit("AP-CON-001").alias("rule_id"),
        value_key(F.lit("IBAN"), F.col("iban_norm")).alias("value_key"),
        iban_mask(F.col("iban_norm")).alias("shown"), F.lit("VENDOR").alias("role"), "bp_key",
    ).select(*MEMBER_COLUMNS)


def cluster_values(model: Model, found: DataFrame) -> DataFrame:
    """The shared IBAN of each finding; all accounts of it are members."""
    clusters = shared_iban_clusters(model).select(
        F.col("anchor"), iban_mask(F.col("iban_norm")).alias("masked"),
        value_key(F.lit("IBAN"), F.col("iban_norm")).alias("value_key"))
    return found.filter("rule_id = 'AP-CON-001'").select(
        "finding_id", F.col("entity.bp_key").alias("anchor"),
        F.col("current.value").alias("masked")).join(clusters, ["anchor", "masked"]).select(
        "finding_id", "value_key", F.lit(None).cast("string").alias("own_key"),
        F.col("masked").alias("iban_masked"))


def shared_iban(model: Model) -> DataFrame:
    """One finding per shared IBAN, at the smallest key; `cluster_members` has all accounts."""
    clusters = shared_iban_clusters(model)
    masked, n = iban_mask(F.col("iban_norm")), F.col("accounts").cast("string")
    return contract(
        clusters, bp_key=F.col("anchor"), role="VENDOR", source_table="TIBAN",
        source_field="IBAN", current_value=masked,
        current_display=said(fixed.IBAN_SHARED, n=n),
        evidence=F.array(
            evidence("deterministic", _bank_reference(), masked, False,
                     said(fixed.IBAN_SHARED_NOTE, n=n), kind="master_field"),
            evidence("deterministic", fixed.PAYER_REFERENCE, fixed.PAYER_NONE, False,
                     fixed.PAYER_NOTE, kind="master_field")),
        params=params(konten=F.col("accounts"), iban_masked=masked,
                      bank_key=F.col("bank_key"), partner_bank_type=F.col("partner_bank_type")),
    )
