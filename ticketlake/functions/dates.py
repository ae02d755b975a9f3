"""Printed and entered purchase times. Wall-clock time without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake.functions.fixed_values import MONTHS


def french_month(name: Column) -> Column:
    """Month number, or null for an unknown name (which makes the receipt fail to parse)."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.element_at(months, F.regexp_replace(F.lower(name), "\\.\\z", ""))


def is_clock_time(month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return (
        month.between(1, 12)
        & day.between(1, 31)
        & minute.between(0, 59)
        & second.between(0, 60)
        & (hour.between(0, 23) | ((hour == 24) & (minute == 0) & (second == 0)))
    )


def purchase_timestamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Wall-clock time from numbers; two-digit years are 20yy, day 31 of a short month rolls over.

    Give plain columns: the numbers are used several times.
    """
    full_year = F.when(year < 100, year + 2000).otherwise(year)
    first = F.make_timestamp_ntz(full_year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    moment = first + F.make_dt_interval(day - 1, hour, minute, second.cast("decimal(18,6)"))
    return F.when(is_clock_time(month, day, hour, minute, second), moment)


def parse_entered_timestamp(value: Column) -> Column:
    """ISO minutes or day/month/year; an impossible date is null; other shapes go to a plain cast."""
    iso = "\\A\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}\\z"
    local = "\\A(\\d{1,2})/(\\d{1,2})/(\\d{4})[ T](\\d{1,2}):(\\d{2})\\z"
    day, month, year, hour, minute = (F.regexp_extract(value, local, i).try_cast("int") for i in range(1, 6))
    entered = purchase_timestamp(year, month, day, hour, minute, F.lit(0))
    return (
        F.when(value.rlike(iso), value.try_cast("timestamp_ntz"))
        .when(value.rlike(local), entered)
        .otherwise(value.try_cast("timestamp_ntz"))
    )
