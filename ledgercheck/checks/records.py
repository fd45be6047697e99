"""Accounts behind a finding about several of them.

A finding of a shared value holds the value and the number of accounts, and no list: a value may
be shared by a third of all accounts.  The accounts are a table of one row per value and account,
and findings lead to it by the key of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model
from ledgercheck.functions import dates, numbers
from ledgercheck.schema import RECORD_FIELDS

MEMBER_COLUMNS = ["rule_id", "value_key", "shown", "role", "bp_key"]


def value_key(criterion: Column, value: Column) -> Column:
    """A short key of a shared value that does not show it."""
    return F.substring(F.sha1(F.concat_ws("|", criterion, value)), 1, 16)


def vat_of_partner(model: Model) -> DataFrame:
    return (
        model["bp_tax_id"].filter(F.col("tax_id_type") == "VAT")
        .groupBy("bp_key").agg(F.max("value").alias("vat_id"))
    )


def partner_fields(model: Model) -> DataFrame:
    """The fields partners are compared in, one row per partner."""
    relevance = model["bp_relevance"].select(
        "bp_key", numbers.amount_text(F.col("open_items_local")).alias("open_items"),
        "currency", dates.iso_text(F.col("last_activity_on")).alias("last_activity_on"),
    )
    partners = model["business_partner"].select(
        "bp_key", F.col("name1").alias("name"), "street", "postal_code", "city", "country"
    )
    rows = partners.join(relevance, "bp_key", "left").join(vat_of_partner(model), "bp_key", "left")
    return rows.select("bp_key", *[
        (F.col(n) if n in rows.columns else F.lit(None)).cast("string").alias(n)
        for n in RECORD_FIELDS])


def field_ranges(rows: DataFrame, key: str) -> DataFrame:
    """Per key the least and greatest value of every field, and whether one is filled."""
    found = []
    for name in RECORD_FIELDS:
        filled = F.coalesce(F.col(name), F.lit(""))
        found += [F.min(filled).alias(f"{name}_low"), F.max(filled).alias(f"{name}_high"),
                  (F.count(name) > 0).alias(f"{name}_filled")]
    return rows.groupBy(key).agg(*found)


def compare_records(model: Model, members: DataFrame, values: DataFrame) -> DataFrame:
    """Per finding and field the least and greatest value among its accounts.

    `members` has the accounts of every value; `values` the values of every finding
    (finding_id, value_key), its own account where that is no member, and `iban_masked`.
    Accounts are summed up per value once, however many findings the value has.
    """
    fields = partner_fields(model)
    per_value = field_ranges(members.select("value_key", "bp_key").join(fields, "bp_key"),
                             "value_key")
    per_finding = values.select("finding_id", "value_key").join(per_value, "value_key")
    own = field_ranges(
        values.filter("own_key IS NOT NULL").select("finding_id", F.col("own_key").alias("bp_key"))
        .distinct().join(fields, "bp_key"), "finding_id")
    both = per_finding.drop("value_key").unionByName(own)
    summed = both.groupBy("finding_id").agg(*[
        part for name in RECORD_FIELDS for part in (
            F.min(f"{name}_low").alias(f"{name}_low"), F.max(f"{name}_high").alias(f"{name}_high"),
            F.bool_or(f"{name}_filled").alias(f"{name}_filled"))])
    masked = values.groupBy("finding_id").agg(F.max("iban_masked").alias("masked"))
    summed = summed.join(masked, "finding_id")

    def entry(position: int, name: str) -> Column:
        low, high, filled = (F.col(f"{name}_{part}") for part in ("low", "high", "filled"))
        if name == "iban_masked":
            low = high = F.coalesce("masked", F.lit(""))
            filled = F.col("masked").isNotNull()
        return F.struct(F.lit(position).alias("position"), F.lit(name).alias("field"),
                        low.alias("low"), high.alias("high"), (low != high).alias("differs"),
                        (~filled).alias("missing"))

    return summed.select("finding_id", F.inline(F.array(*[
        entry(i, name) for i, name in enumerate(RECORD_FIELDS)])))
