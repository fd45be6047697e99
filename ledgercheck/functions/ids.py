"""Identifiers that stay the same from run to run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# the order is part of the identifier
ID_COLUMNS = (
    "bp_key", "company_code", "source_table", "source_field", "current_value", "finding_key",
)


def finding_id(rule_id: Column, row: dict[str, Column] | None = None) -> Column:
    """'F-' and twelve characters of a SHA-1 over rule and row; NULL counts as empty."""
    parts = [rule_id] + [
        F.coalesce((row or {}).get(name, F.col(name)).cast("string"), F.lit(""))
        for name in ID_COLUMNS
    ]
    digest = F.sha1(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("F-"), F.substring(digest, 1, 12))
