"""What every check returns, and what it may read."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgercheck.schema import CONTRACT, EVIDENCE


Settle = Callable[[DataFrame, str], DataFrame]


def unsettled(df: DataFrame, name: str) -> DataFrame:
    return df


@dataclass
class Model:
    """The canonical tables a check reads, and the dates of the run.

    `as_of` and `window_from` are columns: literals, or one-row results of the data.  `settle`
    writes what a check reads several times and reads it back; without it that stays a plan.
    """

    tables: Mapping[str, DataFrame]
    as_of: Column
    window_from: Column
    thresholds: dict = field(default_factory=dict)
    settle: Settle = unsettled

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def having(self, tables: Mapping[str, DataFrame]) -> Model:
        """This model with other tables in place of its own; none of its own is made for that."""
        return replace(self, tables=ChainMap(tables, self.tables))

    def missing(self, required: tuple[str, ...]) -> list[str]:
        return [t for t in required if t not in self.tables]

    def partners(self, role: str, *columns: str) -> DataFrame:
        """Partners of a role without one-time accounts."""
        return self["business_partner"].filter(
            (F.col("role") == role) & ~F.col("is_one_time")
        ).select("bp_key", *columns)


class LazyModel(Model):
    """A model whose tables and dates are made when they are first asked for."""

    def __init__(self, tables: Mapping[str, DataFrame],
                 dates: Callable[[], tuple[Column, Column]], thresholds: dict,
                 settle: Settle = unsettled) -> None:
        self.tables, self.thresholds, self._dates = tables, thresholds, dates
        self.settle = settle

    @cached_property
    def as_of(self) -> Column:
        return self._dates()[0]

    @cached_property
    def window_from(self) -> Column:
        return self._dates()[1]

    def having(self, tables: Mapping[str, DataFrame]) -> LazyModel:
        return LazyModel(ChainMap(tables, self.tables), self._dates, self.thresholds,
                         self.settle)


def evidence(
    source_type: str, reference: Column | str, value: Column | str, agrees: Column | bool,
    note: Column | str, kind: str | None = None, observed_at: Column | None = None,
) -> Column:
    """One piece of evidence."""
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    absent = F.lit(None).cast("string")
    return F.struct(
        F.lit(source_type).alias("source_type"), col(reference).alias("reference"),
        col(kind).cast("string").alias("reference_kind"), col(value).alias("value"),
        (absent if observed_at is None else observed_at).alias("observed_at"),
        col(agrees).alias("agrees"), col(note).alias("note"),
    ).cast(EVIDENCE)


def options(*pairs: tuple[str, str]) -> Column:
    return F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(consequence).alias("consequence"))
        for label, consequence in pairs
    ])


def document(**parts: Column) -> Column:
    """One document of a finding; parts that are not given stay NULL."""
    names = (
        "company_code", "fiscal_year", "document_no", "line_item", "reference",
        "document_date", "cleared_on", "amount", "currency",
    )
    return F.struct(*[
        parts.get(name, F.lit(None)).cast("string").alias(name) for name in names
    ])


def params(**values: Column) -> Column:
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def contract(df: DataFrame, **columns: Column | str | None) -> DataFrame:
    """The contract columns; what a check does not name is NULL."""
    unknown = set(columns) - set(CONTRACT)
    if unknown:
        raise ValueError(f"unknown contract columns: {sorted(unknown)}")
    selected = []
    for name, kind in CONTRACT.items():
        value = columns.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        selected.append(value.cast(kind).alias(name))
    return df.select(*selected)
