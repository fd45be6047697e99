"""Looking at findings: filter, search, sort, count, sum, compare."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgercheck import fixed
from ledgercheck.checks import bank_data, cross_role
from ledgercheck.checks.contract import Model
from ledgercheck.checks.records import compare_records
from ledgercheck.fixed import ACTION_TYPES, IMPACT_KIND, SEVERITIES, SIDES, STATUSES, TIERS
from ledgercheck.operators.ranking import numbered_in_group
from ledgercheck.schema import MONEY

NO_COMPANY_CODE = "none"
TOP_COUNT = 10


# -- predicates and columns --------------------------------------------------------------

def company_code() -> Column:
    return F.coalesce("entity.company_code", F.lit(NO_COMPANY_CODE))


def impact() -> Column:
    return F.col("impact_eur.amount").cast(MONEY)


def is_open() -> Column:
    return F.col("status") == "open"


def is_releasable() -> Column:
    """Bank data (damage class 1) is never released as a group."""
    return F.col("damage_class") != 1


def has_relevance() -> Column:
    return F.coalesce("relevance.open_items", "relevance.volume_12m",
                      "relevance.last_activity_on").isNotNull()


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in a fixed order."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), column)


def accept_blocked(chosen_option: Column) -> Column:
    """Why a finding cannot be accepted as it is, NULL when it can."""
    return F.when(
        F.col("damage_class") == 1, F.lit(fixed.ACCEPT_FOUR_EYES)
    ).when(
        (F.size("proposed.options") > 0) & chosen_option.isNull(),
        F.lit(fixed.ACCEPT_CHOOSE),
    )


# -- filter, search, sort ------------------------------------------------------------------

@dataclass(frozen=True)
class Filters:
    """Each criterion narrows the list; None leaves it open."""

    side: str | None = None
    category: str | None = None
    severity: str | None = None
    tier: str | None = None
    company_code: str | None = None
    status: str | None = None


def matching(findings: DataFrame, filters: Filters = Filters(), search: str = "") -> DataFrame:
    """Findings that meet every filter and contain the search text in one of four fields."""
    for field in fields(filters):
        value = getattr(filters, field.name)
        if value is not None:
            column = company_code() if field.name == "company_code" else F.col(field.name)
            findings = findings.filter(column == value)
    needle = search.strip().lower()
    if needle:
        places = ["entity.bp_key", "entity.display_name", "title", "rule_id"]
        hit = F.lit(False)
        for place in places:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(place)), F.lit(needle)), F.lit(False))
        findings = findings.filter(hit)
    return findings


_SORT_KEYS = {
    "tier": lambda: rank(F.col("tier"), TIERS),
    "severity": lambda: rank(F.col("severity"), SEVERITIES),
    "damage_class": lambda: F.col("damage_class"),
    "side": lambda: rank(F.col("side"), SIDES),
    "rule_id": lambda: F.lower("rule_id"),
    "bp_key": lambda: F.lower("entity.bp_key"),
    "title": lambda: F.lower("title"),
    "impact": lambda: F.coalesce(impact(), F.lit(0)),
    "status": lambda: rank(F.col("status"), STATUSES),
}


def sort_keys(column: str = "impact", descending: bool = True) -> list[Column]:
    """Order by one column, then by severity (worst first) and finding id."""
    key = _SORT_KEYS[column]()
    keys = [key.desc() if descending else key.asc()]
    if column != "severity":
        keys.append(rank(F.col("severity"), SEVERITIES).desc())
    return [*keys, F.col("finding_id").asc()]


def visible(
    findings: DataFrame, action_type: str, filters: Filters = Filters(), search: str = "",
    column: str = "impact", descending: bool = True,
) -> DataFrame:
    """The list one tab shows, in order."""
    shown = matching(findings, filters, search).filter(F.col("action_type") == action_type)
    return shown.orderBy(*sort_keys(column, descending))


def top(findings: DataFrame, n: int = TOP_COUNT) -> DataFrame:
    """The findings with the highest impact."""
    return findings.filter("impact_eur IS NOT NULL").orderBy(*sort_keys()).limit(n)


def company_code_options(findings: DataFrame) -> DataFrame:
    """Company codes that occur, with 'none' last when a finding has no code."""
    return findings.select(company_code().alias("company_code")).distinct().orderBy(
        F.col("company_code") == NO_COMPANY_CODE, F.lower("company_code")
    )


# -- counts and sums -----------------------------------------------------------------------

def _with_zeros(counts: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Counts for every value of a fixed list, zero where nothing was found."""
    every = counts.sparkSession.createDataFrame(
        list(enumerate(order)), f"position int, {column} string"
    )
    return F.broadcast(every).join(counts, column, "left").select(
        "position", column, F.coalesce("n", F.lit(0)).alias("n")
    )


def by_tier(findings: DataFrame) -> DataFrame:
    return _with_zeros(findings.groupBy("tier").agg(F.count("*").alias("n")), "tier", TIERS)


def by_action_type(
    findings: DataFrame, filters: Filters = Filters(), search: str = ""
) -> DataFrame:
    """How many findings each tab has after filter and search."""
    counts = matching(findings, filters, search).groupBy("action_type").agg(
        F.count("*").alias("n")
    )
    return _with_zeros(counts, "action_type", ACTION_TYPES)


def totals_by_currency(findings: DataFrame, *keys: str) -> DataFrame:
    """Exact sum of impact per currency, within the given keys."""
    currency = F.col("impact_eur.currency").alias("currency")
    return findings.filter("impact_eur IS NOT NULL").groupBy(*keys, currency).agg(
        F.sum(impact()).cast("decimal(25,2)").alias("amount")
    )


def impact_kind() -> Column:
    """Whether the money of a finding is gone (loss) or at stake while it stands (exposure)."""
    table = F.create_map(*[F.lit(x) for pair in IMPACT_KIND.items() for x in pair])
    return F.when(F.col("impact_eur").isNotNull(), F.try_element_at(table, F.col("rule_id")))


def totals_by_kind(findings: DataFrame) -> DataFrame:
    """Sums per kind of impact and currency; a loss and an exposure are never added."""
    return totals_by_currency(findings.withColumn("kind", impact_kind()), "kind")


def top_by_kind(findings: DataFrame, n: int = TOP_COUNT) -> DataFrame:
    """The findings with the highest impact of each kind, with their place."""
    by = Window.partitionBy("kind").orderBy(*sort_keys())
    return findings.withColumn("kind", impact_kind()).filter("impact_eur IS NOT NULL").withColumn(
        "place", F.row_number().over(by)).filter(F.col("place") <= n)


def placed(findings: DataFrame, settle: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Every finding with its place in the list of its tab: by impact, severity and id.

    The list is one sort by range over all tabs, so that a tab of any size is spread."""
    ordered = findings.select(
        "finding_id", "action_type", impact().isNull().alias("no_impact"),
        (-impact()).alias("falling"), (-rank(F.col("severity"), SEVERITIES)).alias("worst"))
    return numbered_in_group(ordered, ["action_type"], [
        "no_impact", "falling", "worst", "finding_id"], settle, "placed-findings").select(
        "finding_id", "action_type", "position")


def overview(findings: DataFrame) -> DataFrame:
    """One row: findings, open, decided, and those without an amount."""
    return findings.agg(
        F.count("*").alias("total"), F.count(F.when(is_open(), 1)).alias("open"),
        F.count(F.when(~is_open(), 1)).alias("decided"),
        F.count(F.when(F.col("impact_eur").isNull(), 1)).alias("without_impact"),
    )


def by_category(findings: DataFrame) -> DataFrame:
    """Per category: findings, those without an amount, totals, and its place in the list.

    Categories stand by their amounts, currency by currency, the largest total first;
    both lists are short by definition.
    """
    counts = findings.groupBy("category").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("impact_eur").isNull(), 1)).alias("without_impact"),
    )
    per_category = totals_by_currency(findings, "category").groupBy("category").agg(
        F.map_from_entries(F.collect_list(F.struct("currency", "amount"))).alias("totals")
    )
    order = totals_by_currency(findings).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("a"), "currency"))),
            lambda x: x["currency"]).alias("order")
    ).scalar()
    joined = counts.join(per_category, "category", "left").withColumn("order", order)
    return joined.withColumn("sort_key", F.transform(
        "order", lambda c: -F.coalesce(F.try_element_at(F.col("totals"), c), F.lit(0))
    )).drop("order")


def ordered_categories(findings: DataFrame) -> DataFrame:
    return by_category(findings).orderBy("sort_key", "category").drop("sort_key")


def rule_groups(findings: DataFrame) -> DataFrame:
    """Per rule: how many, open, releasable, with bank data; one tier or several; amount."""
    first = F.min(F.struct("finding_id", "rule_version", "title", "tier")).alias("first")
    return findings.groupBy("rule_id").agg(
        first, F.count("*").alias("total"), F.count(F.when(is_open(), 1)).alias("open"),
        F.count(F.when(is_open() & is_releasable(), 1)).alias("releasable"),
        F.count(F.when(~is_releasable(), 1)).alias("bank_data"),
        (F.min("tier") != F.max("tier")).alias("mixed_tier"),
        F.sum(F.coalesce(impact(), F.lit(0))).cast("decimal(25,2)").alias("impact"),
    ).select("rule_id", "first.rule_version", "first.title", "first.tier", "mixed_tier", "total",
             "open", "releasable", "bank_data", "impact")


# -- one finding in detail -------------------------------------------------------------------

def sorted_evidence(evidence: Column) -> Column:
    """Contradictions first, otherwise in the given order."""
    placed = F.transform(evidence, lambda e, i: F.struct(
        e["agrees"].cast("int").alias("agrees"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda p: p["e"])


def match_reasons(evidence: Column) -> Column:
    """The single reasons a model gave for a match."""
    model = F.filter(evidence, lambda e: e["source_type"] == "model")
    words = F.flatten(F.transform(
        model, lambda e: F.split(F.coalesce(e["value"], F.lit("")), ",")))
    return F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")


def match_note(evidence: Column) -> Column:
    notes = F.transform(F.filter(evidence, lambda e: e["source_type"] == "model"),
                        lambda e: F.trim(e["note"]))
    kept = F.filter(notes, lambda n: n != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def netting_note(evidence: Column) -> Column:
    """The first note that speaks of netting."""
    notes = F.transform(evidence, lambda e: e["note"])
    return F.get(F.filter(notes, lambda n: n.rlike("(?i)netting")), F.lit(0))


def record_comparison(model: Model, findings: DataFrame) -> DataFrame:
    """Per finding about several accounts and field: least and greatest value, whether they
    differ, and whether no account has one."""
    members = bank_data.cluster_members(model).unionByName(
        cross_role.matched_members(model).filter("role = 'VENDOR'"))
    values = bank_data.cluster_values(model, findings).unionByName(
        cross_role.matched_values(model, findings))
    return compare_records(model, members, values)


def document_pairs(findings: DataFrame) -> DataFrame:
    """Documents of leakage findings with the evidence that speaks of each.

    Evidence belongs to a document when its reference is the document's key, or else
    names its number.  A finding with a document nobody speaks of has no comparison.
    """
    key = lambda d: F.concat_ws("/", d["company_code"], d["fiscal_year"], d["document_no"])

    def of_document(d: Column) -> Column:
        exact = F.filter("evidence", lambda e: F.trim(e["reference"]) == key(d))
        named = F.filter("evidence", lambda e: F.array_contains(
            F.split(e["reference"], "[^0-9A-Za-z-]+"), F.trim(d["document_no"])))
        return F.coalesce(F.get(exact, F.lit(0)), F.get(named, F.lit(0)))

    cards = F.transform("entity.documents", lambda d, i: F.struct(
        i.alias("position"), key(d).alias("document_key"), d.alias("document"),
        of_document(d).alias("evidence")))
    paired = findings.filter(
        (F.col("category") == "leakage") & (F.size("entity.documents") >= 2)
    ).withColumn("cards", cards).filter(
        F.forall("cards", lambda c: c["evidence"].isNotNull())
    )
    return paired.select(
        "finding_id", F.trim("proposed.source_summary").alias("reason"),
        netting_note(F.col("evidence")).alias("netting"), F.inline("cards"),
    ).select("finding_id", "position", "document_key", "reason", "netting",
             F.col("evidence.value").alias("value"),
             F.col("evidence.observed_at").alias("observed_at"))
