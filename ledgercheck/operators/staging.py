"""Typing of raw exports: text columns to typed columns, unreadable rows to rejects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.fixed import DATE_INITIALS, REJECT_DEBIT_CREDIT, REJECT_REASON
from ledgercheck.functions import dates, numbers, text
from ledgercheck.schema import MONEY
from ledgercheck.sources.mapping import (
    EXPORT_TABLES,
    TAX_FIELDS,
    ExportTable,
    missing_columns,
    unknown_columns,
)

ROW_NO = "_row_no"
REASON = "_reject_reason"
EXCERPT = "_excerpt"
NOTATIONS = ("de", "iso")


def column_notations(raw: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per amount column 'de', 'iso', or NULL when its values are silent or disagree."""
    proven = {c: numbers.value_notation(F.col(c)) for c in columns}
    seen = raw.agg(*[F.bool_or(proven[c] == notation).alias(f"{c}__{notation}")
                     for c in columns for notation in NOTATIONS])

    def agreed(c: str) -> Column:
        de, iso = (F.coalesce(f"{c}__{n}", F.lit(False)) for n in NOTATIONS)
        return F.when(de & ~iso, F.lit("de")).when(iso & ~de, F.lit("iso"))

    return seen.select(*[agreed(c).alias(c) for c in columns])


def file_notation(raw: DataFrame, table: str, fallback: str | None = None) -> DataFrame:
    """One row with the notation of the export and where it comes from.

    What the file proves beats the given fallback; two columns that prove different
    notations fail the job, because then the file is not one export.
    """
    spec = EXPORT_TABLES[table]
    amounts = [c for c in spec.fields if spec.kind(c) == "amount" and c in raw.columns]
    given = F.lit(fallback).cast("string")
    if not amounts:
        one = raw.sparkSession.range(1)
        return one.select(given.alias("notation"), _notation_origin(F.lit(None), given))
    proven = F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in amounts])))
    message = F.lit(f"{table}: two amount columns prove different decimal notations")
    settled = column_notations(raw, amounts).select(
        F.when(F.size(proven) > 1, F.raise_error(message).cast("string"))
        .otherwise(F.get(proven, F.lit(0))).alias("proven")
    )
    return settled.select(
        F.coalesce("proven", given).alias("notation"), _notation_origin(F.col("proven"), given)
    )


def _notation_origin(proven: Column, given: Column) -> Column:
    return (
        F.when(proven.isNotNull(), F.lit("Datei"))
        .when(given.isNotNull(), F.lit("Parameter"))
        .otherwise(F.lit("unbestimmt"))
        .alias("notation_source")
    )


def _is_initial(column: Column, kind: str) -> Column:
    values = ["", *DATE_INITIALS] if kind == "date" else [""]
    return F.coalesce(F.trim(column), F.lit("")).isin(*values)


_SIMPLE = {
    "date": dates.parse_date, "integer": numbers.parse_integer, "flag": text.parse_flag,
}


def _derived(columns: list[str]) -> dict[str, Column]:
    """Columns the typed ones imply; a sign is applied here and nowhere else."""
    result: dict[str, Column] = {}
    if {"SHKZG", "DMBTR"} <= set(columns):
        result["amount_signed_local"] = text.signed_amount(F.col("DMBTR__typed"), F.col("SHKZG"))
    if "XBLNR" in columns:
        result["reference_norm"] = text.reference_norm(F.col("XBLNR"))
    if "IBAN" in columns:
        result["iban_norm"] = text.iban_norm(F.col("IBAN"))
    for field in TAX_FIELDS:
        if field in columns:
            result[f"{field}_norm"] = text.tax_norm(F.col(field))
    return result


@dataclass
class Staged:
    """A typed export: `typed` holds every row, with the reason it fails or NULL."""

    table: str
    typed: DataFrame
    notation: DataFrame
    columns: list[str]
    missing: list[str]

    @cached_property
    def rows(self) -> DataFrame:
        return self.typed.filter(F.col(REASON).isNull()).drop(REASON, EXCERPT)

    @cached_property
    def rejects(self) -> DataFrame:
        return self.typed.filter(F.col(REASON).isNotNull()).select(
            F.lit("staged").alias("stage"), F.lit(self.table).alias("source_table"),
            F.col(ROW_NO).alias("row_no"), F.col(REASON).alias("reason"),
            F.col(EXCERPT).alias("raw_excerpt"),
        )


def stage(
    raw: DataFrame, table: str, settle: Callable[[DataFrame, str], DataFrame],
    fallback: str | None = None,
) -> Staged:
    """Type one raw export.  All columns of `raw` are text, plus the row number.

    The typed rows are settled: good rows and rejects are two filters over them, and a
    filter pushed down through the typing would unfold all its layers into itself.
    """
    if fallback is not None and fallback not in NOTATIONS:
        raise ValueError(f"unknown decimal notation {fallback!r}, allowed: {NOTATIONS}")
    spec = EXPORT_TABLES[table]
    delivered = [c for c in raw.columns if c != ROW_NO]
    unknown = unknown_columns(spec, delivered)
    if unknown:
        raise ValueError(f"{table}: unknown columns {unknown}; map or ignore them")
    columns = [c for c in spec.fields if c in delivered]
    notation = file_notation(raw, table, fallback)
    df = raw.select(ROW_NO, *columns)
    if any(spec.kind(c) == "amount" for c in columns):
        df = df.withColumn("__notation", notation.select("notation").scalar())
    else:
        df = df.withColumn("__notation", F.lit(None).cast("string"))
    df = settle(_typed(df, spec, columns), f"staged-{table}")
    return Staged(table, df, notation, columns, missing_columns(spec, delivered))


def _typed(df: DataFrame, spec: ExportTable, columns: list[str]) -> DataFrame:
    kinds = {c: spec.kind(c) for c in columns}
    typed = [c for c in columns if kinds[c] != "text"]
    df = numbers.parse_columns(df, kinds, F.col("__notation"))
    simple = {f"{c}__typed": _SIMPLE[kinds[c]](F.col(c)) for c in typed if kinds[c] in _SIMPLE}
    if simple:
        df = df.withColumns(simple)
    reasons = [
        F.when(
            F.col(f"{c}__typed").isNull() & ~_is_initial(F.col(c), kinds[c]),
            F.lit(f"{c}: {REJECT_REASON[kinds[c]]}"),
        )
        for c in typed
    ]
    if "SHKZG" in columns:
        known = F.coalesce(F.trim("SHKZG"), F.lit("")).isin("S", "H")
        reasons.append(F.when(~known, F.lit(REJECT_DEBIT_CREDIT)))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return df.withColumn(REASON, reason).select(
        ROW_NO,
        *[(F.col(f"{c}__typed") if c in typed else F.col(c)).alias(c) for c in columns],
        *[expr.alias(name) for name, expr in _derived(columns).items()],
        REASON,
        F.when(F.col(REASON).isNotNull(), text.excerpt([F.col(c) for c in columns]))
        .alias(EXCERPT),
    )


def control_totals(staged: Staged) -> DataFrame:
    """Signed amount per company code and currency, over the rows that were staged."""
    absent = [c for c in ("BUKRS", "WAERS") if c not in staged.columns]
    if absent:
        raise ValueError(f"{staged.table}: the control total needs {absent}")
    return staged.rows.groupBy(
        F.col("BUKRS").alias("company_code"), F.col("WAERS").alias("currency")
    ).agg(F.sum("amount_signed_local").cast(MONEY).alias("amount"))


def stage_counts(staged: Staged) -> DataFrame:
    """Rows in, staged and rejected; the first is the sum of the other two."""
    return staged.typed.agg(
        F.count("*").alias("rows_raw"),
        F.count(F.when(F.col(REASON).isNull(), 1)).alias("rows_staged"),
        F.count(REASON).alias("rejected"),
    ).select(F.lit(staged.table).alias("table"), "*")


def parse_array(df: DataFrame, key: list[str], column: str, kind: str,
                notation: str | None = None) -> DataFrame:
    """Type every element of an array of texts: one row per element, with its place from 1."""
    rows = df.select(*key, F.posexplode(column).alias("place", "text")).withColumn(
        "place", F.col("place") + 1)
    return parse_values(rows, "text", kind, notation).withColumnRenamed("text__typed", "value")


def parse_values(df: DataFrame, column: str, kind: str, notation: str | None = None) -> DataFrame:
    """Type one text column of any table by the staging rules, as `<column>__typed`."""
    if kind in numbers.SCALES:
        return numbers.parse_columns(df, {column: kind}, F.lit(notation).cast("string"))
    return df.withColumn(f"{column}__typed", _SIMPLE[kind](F.col(column)))
