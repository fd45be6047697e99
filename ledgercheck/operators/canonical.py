"""From staged exports to the canonical tables, with a reason for every row left out.

A fact table is never shuffled as a whole for its checks.  The keys in question — without
a partner, or used twice — are found on narrow columns with a partial aggregation and
settled as a table.  Read back, that table has a known size: Spark joins it by broadcast
while it is small, and by a skew-aware shuffle join when it is not.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck import fixed
from ledgercheck.functions import bank, text
from ledgercheck.operators.staging import REASON, ROW_NO
from ledgercheck.schema import CANONICAL, PRIMARY_KEYS, CanonicalColumn
from ledgercheck.session import Stages, at_once
from ledgercheck.sources.mapping import EXPORT_TABLES, SOURCE_ORDER, TAX_FIELDS, ExportTable

SOURCE = "_source"
_AMBIGUOUS = "_ambiguous"
ASKED = "_asked"
# places of keys in question, in rows of words of 64: at most 16 MB, whatever the number of keys
_MAP_BITS, _MAP_WORDS = 1 << 27, 64
_PREFIXED = ("bp_key", "alt_payer_key", "partner_bp_key", "dunning_recipient_key")
_ITEM_KEY = ("company_code", "fiscal_year", "document_no", "line_item")
_FROM_IBAN = ("iban", "iban_norm", "iban_valid", "valid_from")
_LANGUAGES = ("D", "E")

Settle = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Scope:
    """Which part of the client a run covers; empty means everything."""

    company_codes: tuple[str, ...] = ()
    side: str = "both"
    item_window_from: dt.date | None = None
    item_window_to: dt.date | None = None

    @property
    def roles(self) -> tuple[str, ...]:
        return fixed.ROLES_OF_SIDE[self.side]


@dataclass
class Canonical:
    """Canonical tables; `checked` holds every row in scope with its reject reason."""

    checked: Mapping[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, list[str]] = field(default_factory=dict)
    staged: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, table: str) -> DataFrame:
        names = [c.name for c in CANONICAL[table]]
        return self.checked[table].filter(F.col(REASON).isNull()).select(*names)

    def tables(self) -> Mapping[str, DataFrame]:
        return Stages(self.checked, self.__getitem__)

    def rejects(self) -> DataFrame:
        parts = [
            df.filter(F.col(REASON).isNotNull()).select(
                F.lit("canonical").alias("stage"), F.col(SOURCE).alias("source_table"),
                F.col(ROW_NO).alias("row_no"), F.col(REASON).alias("reason"),
                F.lit(None).cast("string").alias("raw_excerpt"),
            )
            for df in self.checked.values()
        ]
        return reduce(DataFrame.unionByName, parts)


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


# -- columns ---------------------------------------------------------------------------

def _partner_key(spec: ExportTable) -> Column | None:
    source = spec.source_of("bp_key") or spec.source_of("source_id")
    if spec.role is None or source is None:
        return None
    return text.partner_key(F.col(source), fixed.ROLE_PREFIX[spec.role])


def _value(spec: ExportTable, column: CanonicalColumn, delivered: list[str]) -> Column | None:
    """The expression of a canonical column, None when this export does not know it."""
    name, target = column.name, spec.main_target
    if target == "business_partner" and name == "bp_key":
        return _partner_key(spec)
    if target == "business_partner" and name == "role":
        return F.lit(spec.role)
    if target == "fi_item" and name == "item_key":
        return text.item_key(*[F.col(spec.source_of(part)) for part in _ITEM_KEY])
    if target == "fi_item" and name == "is_open":
        return F.lit(spec.is_open)
    if name in delivered:  # derived while staging, or joined to the source
        return F.col(name)
    source = spec.source_of(name)
    if source is None or source not in delivered:
        return F.lit(column.default) if column.default is not None else None
    if name in _PREFIXED and spec.role:
        return text.partner_key(F.col(source), fixed.ROLE_PREFIX[spec.role])
    if column.default is not None:
        return F.coalesce(F.col(source), F.lit(column.default))
    return F.col(source)


def _sources_behind(spec: ExportTable, name: str) -> list[str]:
    """The export fields a required column is made of."""
    parts = {
        ("business_partner", "bp_key"): ("source_id",),
        ("business_partner", "role"): (),
        ("fi_item", "item_key"): _ITEM_KEY,
        ("fi_item", "amount_signed_local"): ("amount_local", "debit_credit"),
        ("fi_item", "is_open"): (),
    }.get((spec.main_target, name), (name,))
    return [spec.source_of(part) for part in parts]


def check_required(staged: Mapping[str, DataFrame]) -> None:
    """Stop before any work when a field behind a required column was not delivered."""
    problems = []
    for name, df in staged.items():
        spec = EXPORT_TABLES[name]
        for column in CANONICAL.get(spec.main_target or "", ()):
            if column.required:
                absent = [s for s in _sources_behind(spec, column.name) if s not in df.columns]
                problems += [f"{name}: {s} is missing, {spec.target}.{column.name} needs it"
                             for s in absent]
    if problems:
        raise ValueError("the canonical tables cannot be built: " + "; ".join(problems))


def _empty_reason(spec: ExportTable, name: str) -> Column:
    message = fixed.REJECT_EMPTY.format(target=spec.main_target, column=name)
    sources = _sources_behind(spec, name)
    if sources:
        message += f" ({', '.join(sources)})"
    return F.when(F.col(name).isNull(), F.lit(message))


# -- lookups that add a column to a source ------------------------------------------------

def emails(adr6: DataFrame) -> DataFrame:
    """One e-mail per address: the first by alphabet, and whether there were more."""
    return (
        adr6.filter((F.trim("SMTP_ADDR") != "") & F.col("ADDRNUMBER").isNotNull())
        .groupBy(F.col("ADDRNUMBER").alias("address_id"))
        .agg(F.min("SMTP_ADDR").alias("email"),
             (F.min("SMTP_ADDR") != F.max("SMTP_ADDR")).alias("ambiguous"))
    )


def ibans(tiban: DataFrame) -> DataFrame:
    """The IBAN with the newest start date per bank account; a tie of two is ambiguous.

    Two aggregations instead of a window: first per account and date, then the newest
    date with what belongs to it.  NULL is the oldest date.
    """
    account = [
        F.col("BANKS").alias("bank_country"), F.col("BANKL").alias("bank_key"),
        F.col("BANKN").alias("account_number"),
        F.coalesce("BKONT", F.lit("")).alias("control_key"),
    ]
    names = ["bank_country", "bank_key", "account_number", "control_key"]
    per_date = (
        tiban.filter(F.trim("IBAN") != "")
        .select(*account, F.col("VALID_FROM").alias("valid_from"), "IBAN", "iban_norm")
        .groupBy(*names, "valid_from")
        .agg(F.min("IBAN").alias("iban"), F.min("iban_norm").alias("iban_norm"),
             (F.min("iban_norm") != F.max("iban_norm")).alias("ambiguous"))
    )
    newest = per_date.groupBy(*names).agg(
        F.max(F.struct("valid_from", "iban", "iban_norm", "ambiguous")).alias("newest")
    )
    return newest.select(*names, "newest.*").withColumn(
        "iban_valid", bank.iban_valid(F.col("iban_norm"))
    )


def terms_texts(t052u: DataFrame) -> DataFrame:
    """One text per terms key: German, then English, then the first other language."""
    rank = F.lit(len(_LANGUAGES))
    for i, code in reversed(list(enumerate(_LANGUAGES))):
        rank = F.when(F.col("SPRAS") == code, F.lit(i)).otherwise(rank)
    return (
        t052u.filter(F.trim("TEXT1") != "")
        .groupBy(F.col("ZTERM").alias("terms_key"))
        .agg(F.min(F.struct(
            rank.alias("rank"), F.col("SPRAS").isNull().alias("no_language"),
            F.col("SPRAS").alias("language"), F.col("TEXT1").alias("description"),
        )).alias("best"))
        .select("terms_key", "best.description")
    )


def _with_lookups(spec: ExportTable, staged: Mapping[str, DataFrame]) -> DataFrame:
    df = staged[spec.name]
    target = spec.main_target
    if target == "business_partner" and "ADR6" in staged and "ADRNR" in df.columns:
        found = emails(staged["ADR6"]).select(F.col("address_id").alias("ADRNR"), "email")
        return df.join(found, "ADRNR", "left")
    if target == "bp_bank_account" and "TIBAN" in staged:
        keys = ["BANKS", "BANKL", "BANKN"]
        if all(k in df.columns for k in [*keys, "BKONT"]):
            found = ibans(staged["TIBAN"]).select(
                F.col("bank_country").alias("BANKS"), F.col("bank_key").alias("BANKL"),
                F.col("account_number").alias("BANKN"), "control_key",
                "iban", "iban_norm", "iban_valid", "valid_from",
                F.col("ambiguous").alias(_AMBIGUOUS),
            )
            control = df.withColumn("control_key", F.coalesce("BKONT", F.lit("")))
            return control.join(found, [*keys, "control_key"], "left").drop("control_key")
    if target == "payment_terms" and "T052U" in staged:
        found = terms_texts(staged["T052U"]).withColumnRenamed("terms_key", "ZTERM")
        return df.join(found, "ZTERM", "left")
    return df


# -- scope -----------------------------------------------------------------------------

def scope_keys(staged: Mapping[str, DataFrame], scope: Scope) -> DataFrame | None:
    """Partners with at least one company row in scope; None when every partner is."""
    parts = []
    for name in staged if scope.company_codes else ():
        spec = EXPORT_TABLES[name]
        if spec.main_target == "bp_company_code" and spec.role in scope.roles:
            parts.append(
                staged[name].filter(F.col("BUKRS").isin(*scope.company_codes))
                .select(_partner_key(spec).alias("_scope_key"))
            )
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).distinct()


def in_scope(df: DataFrame, spec: ExportTable, scope: Scope, keys: DataFrame | None) -> DataFrame:
    """The rows of an export a run covers; decided before any other check of a row."""
    code = spec.source_of("company_code")
    if scope.company_codes:
        if code in df.columns:
            df = df.filter(F.col(code).isin(*scope.company_codes))
        elif _partner_key(spec) is not None and keys is not None:
            key = _partner_key(spec)
            df = df.withColumn("_scope_key", key).join(keys, "_scope_key", "left_semi")
            df = df.drop("_scope_key")
    if spec.main_target == "fi_item":
        if scope.item_window_from:
            df = df.filter(F.col("BUDAT") >= F.lit(scope.item_window_from))
        if scope.item_window_to:
            df = df.filter(F.col("BUDAT") <= F.lit(scope.item_window_to))
    return df


# -- one target ------------------------------------------------------------------------

def _project(spec: ExportTable, df: DataFrame) -> DataFrame:
    """Canonical columns of one source, with the reason of a required column left empty."""
    delivered = df.columns
    values = {c.name: _value(spec, c, delivered) for c in CANONICAL[spec.main_target]}
    reasons = [
        _empty_reason(spec, c.name)
        for c in CANONICAL[spec.main_target] if c.required and values[c.name] is not None
    ]
    ambiguous = _AMBIGUOUS in delivered
    if ambiguous:
        reasons.append(F.when(F.col(_AMBIGUOUS), F.lit(fixed.REJECT_AMBIGUOUS_IBAN)))
    projected = df.select(
        F.lit(spec.name).alias(SOURCE), ROW_NO,
        *[
            (F.lit(None) if values[c.name] is None else values[c.name])
            .cast(c.type).alias(c.name)
            for c in CANONICAL[spec.main_target]
        ],
        *([_AMBIGUOUS] if ambiguous else []),
    )
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return projected.withColumn(REASON, reason).drop(_AMBIGUOUS)


def orphan_keys(rows: DataFrame, partners: DataFrame) -> DataFrame:
    """Partner keys of rows that no partner has."""
    return rows.filter(F.col("bp_key").isNotNull()).select("bp_key").distinct().join(
        partners.select("bp_key"), "bp_key", "left_anti"
    )


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys more than one row has, over all sources.

    Hashes are counted first; only keys whose hash repeats are counted as texts.
    """
    sound = rows.select(*keys, F.xxhash64(*keys).alias("_h")).dropna()
    repeated = sound.groupBy("_h").count().filter("count > 1").select("_h")
    return sound.join(repeated, "_h", "left_semi").groupBy(*keys).count().filter(
        "count > 1").drop("count")


def mark_orphans(rows: DataFrame, orphans: DataFrame) -> DataFrame:
    """Add a reason to rows whose partner is not in the model."""
    orphans = orphans.withColumn("_orphan", F.lit(True))
    reason = F.when(F.col("_orphan"), text.fill(
        fixed.REJECT_ORPHAN, F.create_map(F.lit("bp_key"), F.col("bp_key"))))
    return (
        rows.join(orphans, "bp_key", "left")
        .withColumn(REASON, F.coalesce(F.col(REASON), reason))
        .drop("_orphan")
    )


def mark_duplicates(
    rows: DataFrame, keys: list[str], places: DataFrame, sources: list[str], target: str,
    settle: Settle,
) -> DataFrame:
    """Rows with a reason for those whose key is used twice; `places` are those of
    `repeated_places`.

    Within one source no row wins.  Over several sources the earlier one keeps a key it
    holds with exactly one sound row.  All rows are written once; only those in question, which
    are kept apart from the others, are read for a verdict and written with it.
    """
    marked = settle(with_place(rows, keys, places), f"{target}-marked")
    asked = marked.filter(ASKED).drop(ASKED)
    counts = asked.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"), *[
        agg
        for i, s in enumerate(sources)
        for agg in (
            F.count(F.when(F.col(SOURCE) == s, 1)).alias(f"_n{i}"),
            F.count(F.when((F.col(SOURCE) == s) & F.col(REASON).isNull(), 1)).alias(f"_sound{i}"),
        )
    ]).filter("_n > 1")
    taken, verdicts = F.lit(False), []
    for i, source in enumerate(sources):
        verdicts += [
            F.lit(source),
            F.when(F.col(f"_n{i}") > 1, F.lit("twice")).when(taken, F.lit("taken")),
        ]
        taken = taken | ((F.col(f"_n{i}") == 1) & (F.col(f"_sound{i}") == 1))
    verdict = settle(
        counts.select(*keys, F.create_map(*verdicts).alias("_verdicts")), f"{target}-verdicts"
    )
    words = F.create_map(
        F.lit("columns"), F.lit("/".join(keys)), F.lit("source"), F.col(SOURCE),
        F.lit("key"), F.concat_ws("|", *[F.col(k) for k in keys]), F.lit("target"), F.lit(target))
    found = F.try_element_at(F.col("_verdicts"), F.col(SOURCE))
    reason = F.when(found == "twice", text.fill(fixed.REJECT_TWICE, words)).when(
        found == "taken", text.fill(fixed.REJECT_TAKEN, words))
    told = asked.join(verdict, keys, "left").withColumn(
        REASON, F.coalesce(F.col(REASON), reason)).select(rows.columns)
    return marked.filter(f"NOT {ASKED}").select(rows.columns).unionByName(
        settle(told, f"{target}-asked"))


def _key_place(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(_MAP_BITS))


def key_places(found: DataFrame, keys: list[str]) -> DataFrame:
    """The hashes of keys as bits in rows of words; the number of rows is bounded."""
    return _bitmap(found, _key_place(keys))


def repeated_places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The places of all keys more than one row has: those of the hashes that repeat, so that the
    keys themselves are neither shuffled nor read a second time."""
    hashes = rows.dropna(subset=keys).select(F.xxhash64(*keys).alias("_h"))
    repeated = hashes.groupBy("_h").count().filter("count > 1")
    return _bitmap(repeated, F.pmod(F.col("_h"), F.lit(_MAP_BITS)))


def _word_at(place: Column) -> tuple[Column, Column]:
    """The row of a place and which of its words has the bit."""
    return F.shiftright(place, 12), (F.shiftright(place, 6) % _MAP_WORDS).cast("int")


def _bitmap(found: DataFrame, place: Column) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    row, which = _word_at(place)
    words = found.groupBy(row.alias("_row"), which.alias("_which")).agg(
        F.bit_or(bit).alias("_bits"))
    # a row has as many words as it can have, so lists are short by definition
    filled = F.map_from_entries(F.collect_list(F.struct("_which", "_bits")))
    return words.groupBy("_row").agg(filled.alias("_filled")).select("_row", F.transform(
        F.sequence(F.lit(0), F.lit(_MAP_WORDS - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_filled"), i), F.lit(0).cast("long"))
    ).alias("_words"))


def with_place(rows: DataFrame, keys: list[str], places: DataFrame) -> DataFrame:
    """Rows with `_asked`: false only for those whose key is surely not in question.

    So a row is shuffled for its key only when the key, or one of the same place, is used twice.
    The places are few by definition, so that the rows are never shuffled to meet them."""
    place = _key_place(keys)
    row, which = _word_at(place)
    asked = F.getbit(F.get("_words", which), (place % 64).cast("int")) == 1
    return rows.withColumn("_row", row).join(F.broadcast(places), "_row", "left").withColumn(
        ASKED, F.coalesce(asked, F.lit(False))).drop("_row", "_words")


def _tax_rows(spec: ExportTable, df: DataFrame) -> DataFrame:
    """One row per filled tax field of a partner."""
    fields = [f for f in TAX_FIELDS if f in df.columns and f"{f}_norm" in df.columns]
    entries = F.array(*[
        F.struct(F.lit(TAX_FIELDS[f]).alias("tax_id_type"), F.col(f).alias("value"),
                 F.col(f"{f}_norm").alias("value_norm"))
        for f in fields
    ]).cast("array<struct<tax_id_type:string,value:string,value_norm:string>>")
    return (
        df.select(F.lit(spec.name).alias(SOURCE), ROW_NO, _partner_key(spec).alias("bp_key"),
                  F.inline(entries))
        .filter(F.trim("value") != "")
        .select(SOURCE, ROW_NO, "bp_key", "tax_id_type",
                F.lit(None).cast("string").alias("country"), "value", "value_norm",
                F.lit(None).cast("string").alias(REASON))
    )


def build_canonical(
    staged: Mapping[str, DataFrame], scope: Scope | None = None, settle: Settle = _lazy,
    lazy: bool = False,
) -> Canonical:
    """All canonical tables the staged exports can fill.

    `settle(df, name)` writes an intermediate result and reads it back; without it the
    whole model stays one lazy plan.  With `lazy` a table, and the exports it is filled from, is
    made when it is first asked for.
    """
    scope = scope or Scope()
    if not lazy:
        check_required(staged)
    model = Canonical(staged=staged)
    keys = scope_keys(staged, scope)
    if keys is not None:
        keys = settle(keys, "scope-keys")
    ordered = [n for n in SOURCE_ORDER if n in staged]

    def sources(target: str) -> list[str]:
        return [
            n for n in ordered
            if EXPORT_TABLES[n].main_target == target
            or (target == "bp_tax_id" and EXPORT_TABLES[n].main_target == "business_partner")
        ]

    def in_use(target: str) -> list[str]:
        return [n for n in sources(target)
                if EXPORT_TABLES[n].role is None or EXPORT_TABLES[n].role in scope.roles]

    def build(target: str) -> DataFrame:
        used = in_use(target)
        if lazy:
            Stages(used, staged.__getitem__).all()
            check_required({n: staged[n] for n in used})
        parts = []
        for name in used:
            spec = EXPORT_TABLES[name]
            if target == "bp_tax_id":
                parts.append(_tax_rows(spec, in_scope(staged[name], spec, scope, keys)))
            else:
                df = in_scope(_with_lookups(spec, staged), spec, scope, keys)
                parts.append(_project(spec, df))
        rows = reduce(DataFrame.unionByName, parts)
        key = list(PRIMARY_KEYS.get(target, ()))
        places = settle(repeated_places(rows, key), f"{target}-places") if key else None
        if target != "business_partner" and "bp_key" in rows.columns:
            orphans = orphan_keys(rows, model["business_partner"])
            rows = mark_orphans(rows, settle(orphans, f"{target}-orphans"))
        if key:
            return mark_duplicates(rows, key, places, used, target, settle)
        return settle(rows, target)

    model.skipped = {t: [n for n in sources(t) if n not in in_use(t)] for t in CANONICAL}
    # a table asks for the partners itself: they are made first
    model.checked = Stages([t for t in CANONICAL if in_use(t)], build)
    if not lazy:
        model.checked.all()
    return model


# -- counts and hints ----------------------------------------------------------------------

def conservation(model: Canonical) -> DataFrame:
    """Per target: rows taken, rejected and out of scope; with `staged` as their sum."""
    parts = []
    for target, rows in model.checked.items():
        tax = target == "bp_tax_id"
        found = rows.agg(
            F.count(F.when(F.col(REASON).isNull(), 1)).alias("rows"),
            F.count(REASON).alias("rejected"),
        )
        names = [
            n for n in model.staged
            if EXPORT_TABLES[n].main_target == ("business_partner" if tax else target)
        ]
        if tax:  # a partner has no, one or several tax ids: only skipped roles are outside
            names = [n for n in names if n in model.skipped[target]]
        delivered = [model.staged[n].agg(F.count("*").alias("n")) for n in names]
        if delivered:
            total = reduce(DataFrame.unionByName, delivered).agg(F.sum("n").alias("n"))
            staged_rows = total.scalar()
        else:
            staged_rows = F.lit(0).cast("bigint")
        outside = staged_rows if tax else staged_rows - F.col("rows") - F.col("rejected")
        parts.append(found.select(
            F.lit(target).alias("table"), "rows", "rejected",
            outside.cast("bigint").alias("out_of_scope"),
        ))
    return reduce(DataFrame.unionByName, parts)


def delivered_window(staged: Mapping[str, DataFrame]) -> DataFrame:
    """First and last posting date that was delivered, before any scope."""
    days = [staged[name].select(F.col("BUDAT").alias("day")) for name in staged
            if EXPORT_TABLES[name].main_target == "fi_item"]
    return reduce(DataFrame.unionByName, days).agg(
        F.min("day").alias("posting_date_from"), F.max("day").alias("posting_date_to")
    )


def unknown_vat_prefixes(tax_ids: DataFrame) -> DataFrame:
    """Letter prefixes of VAT ids no pattern exists for, with their number."""
    prefix = text.vat_prefix(F.col("value_norm"))
    return (
        tax_ids.filter((F.col("tax_id_type") == "VAT")
                       & text.has_letter_prefix(F.col("value_norm"))
                       & ~prefix.isin(*fixed.VAT_PATTERNS))
        .groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    )


def tiered_terms(payment_terms: DataFrame) -> DataFrame:
    """Terms keys with several rows, one of which a finding will show."""
    return payment_terms.groupBy("terms_key").agg(F.count("*").alias("n")).filter("n > 1")
