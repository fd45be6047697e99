"""Dates and time stamps in export text, and dates as German text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """20260830, 2026-08-30 or 30.8.2026 to DATE.

    Initial values are NULL, and so is a day the calendar does not have.
    """
    t = F.trim(text)
    day, year = F.substring_index(t, ".", 1), F.substring_index(t, ".", -1)
    month = F.substring_index(F.substring_index(t, ".", 2), ".", -1)
    compact = F.concat_ws("-", F.left(t, F.lit(4)), F.substring(t, 5, 2), F.substring(t, 7, 2))
    dashed = (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-")
    iso = (
        F.when(F.contains(t, F.lit(".")), F.when(
            (F.length(year) == 4) & (F.concat_ws(".", day, month, year) == t),
            F.concat_ws("-", year, month, day)))
        .when((F.length(t) == 8), compact)
        .when((F.length(t) == 10) & dashed, t)
    )
    # the cast knows the calendar; the patterns keep out what else it would accept
    digits = F.concat_ws("-", F.left(text, F.lit(4)), F.substring(text, 5, 2),
                         F.substring(text, 7, 2))
    return F.when(text.rlike(r"^[0-9]{8}\z"), digits.try_cast("date")).when(
        t.rlike(r"^[0-9.-]{8,10}\z"), iso.try_cast("date"))


def date_text(day: Column) -> Column:
    """DATE to '30.08.2026'."""
    return F.date_format(day, "dd.MM.yyyy")


def iso_text(day: Column) -> Column:
    """DATE to '2026-08-30'."""
    return F.date_format(day, "yyyy-MM-dd")


def _utc_stamp(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.try_to_timestamp(text))


def utc_minute_text(text: Column) -> Column:
    """'2026-08-30T09:15:00Z' to '30.08.2026 09:15 UTC'; other forms are NULL."""
    stamp = _utc_stamp(text, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z\z")
    return F.concat(F.date_format(stamp, "dd.MM.yyyy HH:mm"), F.lit(" UTC"))


def utc_stamp_text(text: Column) -> Column:
    """An ISO 8601 time with offset zero to '…Z'; no offset or another one is NULL."""
    stamp = _utc_stamp(
        text, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]00:?00)\z"
    )
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def months_back(day: Column, months: int) -> Column:
    """The same day some months earlier, or the last day of a shorter month."""
    return F.add_months(day, -months)
