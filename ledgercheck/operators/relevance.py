"""How much a partner matters: open items, twelve-month volume, last activity."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.fixed import ACTIVITY_STATUSES, DOC_TYPES, SIDE_OF_ROLE
from ledgercheck.functions import dates
from ledgercheck.schema import MONEY

WINDOW_MONTHS = 12


def doc_types(side: str, *classes: str) -> list[str]:
    """The document types of one or more classes; asking for none of them is an error."""
    found = [code for name in classes for code in DOC_TYPES[side][name]]
    if not found:
        raise ValueError(f"no document type of class {classes} on side {side}")
    return found


def house_currency(company_codes: DataFrame) -> DataFrame:
    """One row with the only house currency; none or several fail the job."""
    found = company_codes.agg(
        F.min("currency").alias("low"), F.max("currency").alias("high")
    )
    none = F.raise_error(F.lit("no house currency in scope: T001 is missing")).cast("string")
    several = F.raise_error(
        F.concat(F.lit("several house currencies in one run: "), "low", F.lit(", "), "high")
    ).cast("string")
    return found.select(
        F.when(F.col("low").isNull(), none).when(F.col("low") != F.col("high"), several)
        .otherwise(F.col("low")).alias("currency")
    )


def data_as_of(items: DataFrame, given: dt.date | None = None) -> DataFrame:
    """One row with the date of the data: the given one, or the last posting or clearing."""
    if given is not None:
        return items.sparkSession.range(1).select(
            F.lit(given).alias("as_of"), F.lit("Angabe").alias("source")
        )
    latest = F.max(F.greatest("posting_date", "clearing_date"))
    missing = F.raise_error(F.lit("no item to derive the data date from")).cast("date")
    return items.agg(latest.alias("latest")).select(
        F.coalesce("latest", missing).alias("as_of"), F.lit("Daten").alias("source")
    )


def _sums(role: str, as_of: Column, window_from: Column) -> Column:
    """Open amount and volume of an item group, read as postings of this role."""
    factor = F.lit(-1) if role == "VENDOR" else F.lit(1)
    amount = F.col("amount_signed_local") * factor
    counted = F.col("doc_type").isin(*doc_types(SIDE_OF_ROLE[role], "invoice", "credit_memo"))
    inside = (F.col("posting_date") > window_from) & (F.col("posting_date") <= as_of)
    return F.struct(
        F.sum(F.when(F.col("is_open"), amount).otherwise(0)).alias("open_items"),
        F.sum(F.when(counted & inside, amount).otherwise(0)).alias("volume"),
    )


def build_relevance(
    partners: DataFrame, items: DataFrame, as_of: Column, currency: Column
) -> DataFrame:
    """One row per partner, also for one without any item.

    Items are summed per key before they meet a partner, once in each role's reading:
    the sums shrink on the map side, however many items one partner holds, and the
    partner's role only picks the reading afterwards.
    """
    window_from = dates.months_back(as_of, WINDOW_MONTHS)
    known = F.greatest(
        F.when(F.col("posting_date") <= as_of, F.col("posting_date")),
        F.when(F.col("clearing_date") <= as_of, F.col("clearing_date")),
    )
    sums = items.groupBy("bp_key").agg(
        _sums("CUSTOMER", as_of, window_from).alias("customer"),
        _sums("VENDOR", as_of, window_from).alias("vendor"),
        F.max(known).alias("last_activity_on"),
        F.lit(True).alias("has_items"),
    )
    reading = F.when(F.col("role") == "VENDOR", F.col("vendor")).otherwise(F.col("customer"))
    joined = partners.select("bp_key", "role", "created_on").join(sums, "bp_key", "left")
    last = F.col("last_activity_on")
    active, dormant, never = (F.lit(s) for s in ACTIVITY_STATUSES)
    status = (
        F.when(F.col("has_items").isNull() & (F.col("created_on") > window_from), never)
        .when(last.isNull() | (last <= window_from), dormant)
        .otherwise(active)
    )
    return joined.select(
        "bp_key",
        F.coalesce(reading["open_items"], F.lit(0)).cast(MONEY).alias("open_items_local"),
        F.coalesce(reading["volume"], F.lit(0)).cast(MONEY).alias("volume_12m_local"),
        currency.alias("currency"), last.alias("last_activity_on"),
        status.alias("activity_status"),
    )


def status_distribution(relevance: DataFrame) -> DataFrame:
    """Partners per activity status in fixed order, zero included."""
    order = relevance.sparkSession.createDataFrame(
        list(enumerate(ACTIVITY_STATUSES)), "position int, activity_status string"
    )
    counted = relevance.groupBy("activity_status").agg(F.count("*").alias("n"))
    return F.broadcast(order).join(counted, "activity_status", "left").select(
        "position", "activity_status", F.coalesce("n", F.lit(0)).alias("n")
    )


def relevance_totals(relevance: DataFrame) -> DataFrame:
    return relevance.agg(
        F.count("*").alias("partners"),
        F.sum("open_items_local").cast(MONEY).alias("open_items_total"),
        F.sum("volume_12m_local").cast(MONEY).alias("volume_12m_total"),
    )


def unclassified_doc_types(partners: DataFrame, items: DataFrame) -> DataFrame:
    """Document types no class knows, per role.

    Counted per partner and type first, so that the join to partners sees counts only.
    """
    per_partner = items.filter(F.col("doc_type").isNotNull()).groupBy("bp_key", "doc_type").agg(
        F.count("*").alias("n")
    )
    known = reduce(lambda a, b: a | b, [
        (F.col("role") == role)
        & F.col("doc_type").isin(*[c for codes in DOC_TYPES[side].values() for c in codes])
        for role, side in SIDE_OF_ROLE.items()
    ])
    return (
        per_partner.join(partners.select("bp_key", "role"), "bp_key")
        .filter(~known).groupBy("role", "doc_type").agg(F.sum("n").alias("n"))
    )


def dunning_levels(items: DataFrame, as_of: Column) -> DataFrame:
    """Dunning level per customer and company code, from the age of the oldest open debit."""
    from ledgercheck.fixed import DUNNING_LEVELS

    oldest = (
        items.filter(F.col("is_open") & (F.col("debit_credit") == "S"))
        .groupBy("bp_key", "company_code").agg(F.min("document_date").alias("oldest"))
    )
    age = F.datediff(as_of, F.col("oldest"))
    level = F.lit(None).cast("int")
    for limit, value in reversed(DUNNING_LEVELS):
        level = F.when(age >= limit, F.lit(value)).otherwise(level)
    return (
        oldest.withColumn("dunning_level", level).filter("dunning_level IS NOT NULL")
        .withColumn("last_dunned_on", F.least(
            F.date_add("oldest", F.col("dunning_level") * 30), as_of))
    )
