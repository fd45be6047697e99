"""Invoices that were possibly paid twice.

Two paid invoices of one vendor match when currency and amount are equal, the dates are
at most 60 days apart and the references differ in at most one character.  A standing fee
puts very many invoices under one vendor and amount, so no group is ever paired off: every
later invoice has one finding, with its nearest earlier match and the number of its matches.

Invoices of a small group (one vendor, currency and amount) are compared with each other, of a large
one by keys.  Equal keys prove a match: the same reference; the same rest when the character at the
same place is taken out; or one reference whole and the other without one character.  Per key only
days are kept, with the first invoice and the number of each; days are bounded by the calendar.  The
nearest earlier match is the first invoice of the latest day, the own day included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model, contract, document, evidence, params
from ledgercheck import fixed
from ledgercheck.functions import dates, numbers
from ledgercheck.functions.text import said
from ledgercheck.operators.relevance import doc_types

MAX_DAYS = 60
NETTING_DAYS = 180
SMALL_GROUP = 64  # invoices of one vendor, currency and amount that are compared one by one
_SAME = ["bp_key", "currency", "amount_doc"]
# a number in front of texts that begin alike: sorts seldom come to the texts
_GROUP = "_group"


def _number(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def match_keys(reference: Column) -> Column:
    """The keys of a reference: kind (e equal, s one character replaced, w whole, c cut), the place
    and the text.  A whole text and a cut one meet under one name."""
    places = F.when(F.length(reference) > 0, F.sequence(F.lit(1), F.length(reference))).otherwise(
        F.array().cast("array<int>"))

    def without(i: Column) -> Column:
        return F.concat(F.substring(reference, F.lit(1), i - 1),
                        F.substring(reference, i + 1, F.length(reference)))

    def key(kind: str, place: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"),
                        text.alias("text"))

    none = F.lit(0)
    cuts = F.array_distinct(F.transform(places, without))
    return F.concat(
        F.array(key("e", none, reference), key("w", none, reference)),
        F.transform(places, lambda i: key("s", i, without(i))),
        F.transform(cuts, lambda t: key("c", none, t)))


def paid_invoices(model: Model, *more: str) -> DataFrame:
    """Paid items of a vendor invoice type, with a reference and a date; `more` goes along."""
    return (
        model["fi_item"]
        .filter((F.col("debit_credit") == "H") & ~F.col("is_open")
                & F.col("doc_type").isin(*doc_types("AP", "invoice"))
                & F.col("reference_norm").isNotNull() & F.col("document_date").isNotNull())
        .select(_number(*_SAME).alias(_GROUP), *_SAME, "item_key", "company_code", "fiscal_year",
                "document_no", "reference", "reference_norm", "document_date", *more)
    )


def repeated_amounts(invoices: DataFrame) -> DataFrame:
    """Invoices that have another of their vendor, currency and amount within MAX_DAYS days; the
    rest cannot pair.  A row per day is compared, so a group is bounded by the calendar.
    `in_group` counts the invoices of the vendor, currency and amount."""
    # two groups of one number only keep more invoices than could pair
    days = invoices.groupBy(_GROUP, "document_date").agg(F.count("*").alias("n"))
    group = Window.partitionBy(_GROUP)
    order = group.orderBy("document_date")
    gaps = [F.datediff("document_date", F.lag("document_date").over(order)),
            F.datediff(F.lead("document_date").over(order), "document_date")]
    close = days.withColumns({"gap": F.least(*gaps), "in_group": F.sum("n").over(group)}).filter(
        (F.col("n") > 1) | (F.col("gap") <= MAX_DAYS)).select(_GROUP, "document_date", "in_group")
    return invoices.join(close, [_GROUP, "document_date"])


def credit_dates(model: Model) -> DataFrame:
    """The dates with a credit memo per vendor, currency and amount, as a sorted array.

    Its length is bounded by the calendar, not by the number of credit memos.
    """
    return (
        model["fi_item"]
        .filter((F.col("debit_credit") == "S")
                & F.col("doc_type").isin(*doc_types("AP", "credit_memo"))
                & F.col("document_date").isNotNull())
        .select(*_SAME, "document_date").distinct()
        .groupBy(_number(*_SAME).alias(_GROUP), *_SAME).agg(
            F.collect_set("document_date").alias("credit_dates"))
    )


def not_netted(invoices: DataFrame, model: Model) -> DataFrame:
    """Mark invoices followed by a credit memo of the amount within 180 days.

    Whether a pair is netted depends on its later invoice only, so it is decided once
    per invoice and not per pair.
    """
    day = F.col("document_date")
    followed = F.exists(
        "credit_dates", lambda c: (c >= day) & (c <= F.date_add(day, NETTING_DAYS))
    )
    return invoices.join(credit_dates(model), [_GROUP, *_SAME], "left").withColumn(
        "netted", F.coalesce(followed, F.lit(False))
    ).drop("credit_dates")


def nearest_matches(invoices: DataFrame) -> DataFrame:
    """Per invoice with an earlier match: its key, the nearest match's key, and how many others
    match that are dated up to 60 days before or on its day."""
    small = F.col("in_group") <= SMALL_GROUP
    return matches_one_by_one(invoices.filter(small)).union(
        matches_by_keys(invoices.filter(~small)))


def matches_one_by_one(invoices: DataFrame) -> DataFrame:
    """The nearest matches within groups of a bounded number of invoices."""
    slim = invoices.select(_GROUP, *_SAME, "item_key", "document_date", "reference_norm",
                           _number("item_key").alias("_item"))
    late, other = slim.alias("a"), slim.alias("b")
    gap = F.datediff("a.document_date", "b.document_date")
    pairs = late.join(other, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (_GROUP, *_SAME)] + [
        gap.between(0, MAX_DAYS), F.col("a.item_key") != F.col("b.item_key"),
        F.levenshtein("a.reference_norm", "b.reference_norm", 1) >= 0])
    earlier = F.when((gap > 0) | (F.col("b.item_key") < F.col("a.item_key")), F.struct(
        gap.alias("gap"), F.col("b.item_key").alias("item")))
    return pairs.groupBy("a._item", "a.item_key").agg(
        F.min(earlier).alias("m"), F.count("*").alias("matches"),
    ).filter("m IS NOT NULL").select("item_key", F.col("m.item").alias("earlier_key"), "matches")


def matches_by_keys(invoices: DataFrame) -> DataFrame:
    """The nearest matches within groups of any size."""
    slim = invoices.select(
        "item_key", F.col("document_date").alias("day"), F.length("reference_norm").alias("letters"),
        F.explode(match_keys(F.col("reference_norm"))).alias("k"), *_SAME)
    meeting = F.when(F.col("k.kind").isin("w", "c"), "d").otherwise(F.col("k.kind"))
    whole = F.col("k.kind") == "w"
    # 128 bits in place of the texts
    rows = slim.select(
        "item_key", "day", "letters", F.col("k.kind").alias("kind"),
        *[F.xxhash64(F.lit(seed), *_SAME, meeting, "k.place", "k.text").alias(f"g{seed}")
          for seed in (1, 2)])
    group = ["g1", "g2"]
    days = rows.groupBy(*group, "day").agg(*[
        made for kind, which in (("cut", F.col("kind") == "c"), ("rest", F.col("kind") != "c"))
        for made in (F.min(F.when(which, F.col("item_key"))).alias(f"{kind}_first"),
                     F.count(F.when(which, 1)).alias(f"{kind}_n"))])
    # a row per day: a group is bounded by the calendar
    number = F.datediff("day", F.lit("1970-01-01"))
    before = Window.partitionBy(*group).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    lately = Window.partitionBy(*group).orderBy(number).rangeBetween(-MAX_DAYS, 0)
    for kind in ("cut", "rest"):
        found = F.when(F.col(f"{kind}_n") > 0, F.struct("day", F.col(f"{kind}_first").alias("item")))
        days = days.withColumn(f"{kind}_last", F.last(found, ignorenulls=True).over(before)) \
            .withColumn(f"{kind}_count", F.sum(f"{kind}_n").over(lately))
    joined = rows.join(days, [*group, "day"])
    # a whole reference meets cut ones and the other way round; else like meets like
    cut_side = F.col("kind") == "w"

    def of(name: str) -> Column:
        return F.when(cut_side, F.col(f"cut_{name}")).otherwise(F.col(f"rest_{name}"))

    last = of("last")
    today = F.when(of("first") < F.col("item_key"), F.struct(F.lit(0).alias("gap"),
                                                             of("first").alias("item")))
    gap = F.datediff("day", last["day"])
    earlier = F.when(gap <= MAX_DAYS, F.struct(gap.alias("gap"), last["item"].alias("item")))
    # equal references share every replaced character; they count once, and not themselves
    weight = F.when(F.col("kind") == "e", 1 - F.col("letters")).otherwise(F.lit(1))
    return joined.groupBy("item_key").agg(
        F.min(F.coalesce(today, earlier)).alias("m"),
        (F.sum(weight * of("count")) - 1).alias("matches"),
    ).filter("m IS NOT NULL").select("item_key", F.col("m.item").alias("earlier_key"), "matches")


def invoice_pairs(invoices: DataFrame, *more: str) -> DataFrame:
    """Every invoice that is not netted with its nearest earlier match; a has the smaller key."""
    rest = ["item_key", "company_code", "fiscal_year", "document_no", "reference", "document_date",
            *more]
    near = nearest_matches(invoices).withColumn("_item", _number("item_key"))
    later = invoices.filter(~F.col("netted")).select(
        _number("item_key").alias("_item"), "item_key", *_SAME, F.struct(*rest).alias("l")).join(
        near, ["_item", "item_key"])
    first = invoices.select(_number("item_key").alias("_earlier"), F.col("item_key").alias(
        "earlier_key"), F.struct(*rest).alias("e"))
    pairs = later.drop("_item", "item_key").withColumn("_earlier", _number("earlier_key")).join(
        first, ["_earlier", "earlier_key"])
    swap = F.col("e.item_key") > F.col("l.item_key")
    return pairs.select(
        *_SAME, "matches",
        F.when(swap, F.col("l")).otherwise(F.col("e")).alias("a"),
        F.when(swap, F.col("e")).otherwise(F.col("l")).alias("b"),
    )


def candidates(model: Model, *more: str) -> DataFrame:
    """The paid invoices that may pair, each marked as netted or not; they are read several times."""
    return model.settle(not_netted(repeated_amounts(paid_invoices(model, *more)), model),
                        "paid-invoices")


def double_payment(model: Model) -> DataFrame:
    """Paid invoices that look like an earlier one paid twice.

    Both invoices have one partner, so the role is asked of the pairs and not of all invoices.
    """
    vendors = model["business_partner"].filter("role = 'VENDOR'").select("bp_key")
    pairs = invoice_pairs(candidates(model)).join(vendors, "bp_key", "left_semi")
    money = numbers.money(F.col("amount_doc"), F.col("currency"))
    gap = F.abs(F.datediff("a.document_date", "b.document_date")).cast("string")

    def proof(side: str, note: str) -> Column:
        return evidence(
            "deterministic",
            F.concat_ws("/", "a.company_code", f"{side}.fiscal_year", f"{side}.document_no"),
            F.col(f"{side}.reference"), True, note,
            observed_at=dates.iso_text(F.col(f"{side}.document_date")))

    def invoice(side: str) -> Column:
        return document(company_code=F.col("a.company_code"),
                        fiscal_year=F.col(f"{side}.fiscal_year"),
                        document_no=F.col(f"{side}.document_no"))

    return contract(
        pairs, bp_key=F.col("bp_key"), role="VENDOR", company_code=F.col("a.company_code"),
        source_table="BSAK", source_field="XBLNR",
        current_value=F.concat("a.reference", F.lit(" | "), "b.reference"),
        current_display=said(fixed.PAID_TWICE, money=money),
        proposed_display=fixed.PAID_TWICE_PROPOSAL,
        source_summary=said(
            fixed.PAID_TWICE_SUMMARY, a=F.col("a.document_no"), b=F.col("b.document_no"), days=gap,
            likeness=F.when(F.col("a.reference") == F.col("b.reference"), F.lit("identisch"))
            .otherwise(F.lit("nahezu identisch")),
            more=F.when(F.col("matches") > 1, said(fixed.PAID_TWICE_MORE, n=F.col("matches")))
            .otherwise(F.lit(""))),
        evidence=F.array(proof("a", "Rechnung A"), proof("b", "Rechnung B")),
        impact_amount=F.col("amount_doc"), impact_currency=F.col("currency"),
        impact_formula=fixed.PAID_TWICE_FORMULA,
        documents=F.array(invoice("a"), invoice("b")),
        params=params(amount=money, currency=F.col("currency"), ref_a=F.col("a.reference"),
                      ref_b=F.col("b.reference")),
        finding_key=F.concat("a.document_no", F.lit("|"), "b.document_no"),
    )
