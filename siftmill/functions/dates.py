"""Date arithmetic as column expressions (all safe under ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column | str, pattern: str) -> Column:
    """Text to timestamp, NULL when it does not match the pattern."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(c, F.lit(pattern))


def month_of(t: Column | str) -> Column:
    """Calendar month as ``yyyy-MM``."""
    return F.date_format(t, "yyyy-MM")


def month_number(t: Column | str) -> Column:
    """Months since year 0, for month differences."""
    return F.year(t) * 12 + F.month(t)


def months_before(field: Column | str, obs: Column | str) -> Column:
    """Whole calendar months from ``field`` to the observation point."""
    return month_number(obs) - month_number(field)


def days_from(t: Column | str, ref: Column | str | None = None) -> Column:
    """Whole days (floor) from ``ref`` to ``t``; from 1970-01-01 without ``ref``.

    Seconds of the day decide the floor, so the result does not depend on the session zone.
    """
    def day(c):
        return F.unix_date(c.cast("date"))

    def second(c):
        return F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c).cast("double")

    c = F.col(t) if isinstance(t, str) else t
    if ref is None:
        return day(c).cast("long")
    r = F.col(ref) if isinstance(ref, str) else ref
    return (day(c) - day(r) - F.when(second(c) < second(r), 1).otherwise(0)).cast("long")


def relative_day_to_date(ref: Column | str, days: Column | str) -> Column:
    """Days relative to a reference date as a date (negative = past)."""
    r = F.lit(ref).cast("date") if isinstance(ref, str) else ref
    return F.date_add(r, F.col(days).cast("int") if isinstance(days, str) else days)


def month_start(month: str) -> str:
    return f"{month}-01"


def next_month_start(month: str) -> str:
    year, number = (int(x) for x in month.split("-"))
    return f"{year + number // 12:04d}-{number % 12 + 1:02d}-01"
