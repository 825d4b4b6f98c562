"""Date parts used as grouping keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(at: str | Column) -> Column:
    return F.to_date(at)


def hour_of_day(at: str | Column) -> Column:
    return F.hour(at)


def weekday_from_zero(at: str | Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(at) - 1


def whole_hours(start: Column, end: Column) -> Column:
    """Completed hours between two timestamps: 2 h 59 min gives 2.

    Taken from the interval itself, so TIMESTAMP_NTZ values do not pass through
    the session time zone.
    """
    gap = end - start
    days = F.extract(F.lit("DAY"), gap).cast("bigint")
    hours = F.extract(F.lit("HOUR"), gap).cast("bigint")
    return days * 24 + hours
