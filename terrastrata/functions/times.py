"""Time functions: file names, climate-and-forecast units, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds in each unit that is a plain duration.
UNIT_SECONDS = {"seconds": 1, "hours": 3600, "days": 86400}


def add_months(ts: Column, months: Column) -> Column:
    """Calendar months with overflow: the day of month counts on from the first (31 January + 1 month: 3 March)."""
    first = F.add_months(F.trunc(ts, "month"), months.cast("int"))
    day = F.date_add(first, F.dayofmonth(ts) - 1).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts), F.second(ts))


def decode_cf(value: Column, units: Column) -> Column:
    """``value`` in ``<unit> since <date>`` as a timestamp; null where the units don't read so.

    Days keep their fraction, seconds, hours, months and years don't; an unknown unit adds nothing.
    """
    words = F.split(F.trim(units), r"\s+")
    unit = F.get(words, F.lit(0))
    start = F.try_to_timestamp(F.regexp_replace(F.array_join(F.slice(words, 3, 2), " "), r"\.0$", ""), F.lit("yyyy-M-d[ H:m:s]")).cast("timestamp_ntz")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    seconds = F.when(unit == "days", value * 86400).when(unit == "hours", whole * 3600).when(unit == "seconds", whole).otherwise(F.lit(0.0))
    months = F.when(unit == "months", whole).when(unit == "years", whole * 12).otherwise(F.lit(0))
    # The interval's seconds have twelve digits, about 31,700 years; whole days go apart.
    days = F.floor(seconds / 86400)
    moved = add_months(start, months) + F.make_dt_interval(days.try_cast("int"), F.lit(0), F.lit(0), (seconds - days * 86400).cast("decimal(18,6)"))
    return F.when(F.get(words, F.lit(1)) == "since", moved)


def from_name(year: Column, julian: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Time from a file name's fields: year, then day of year, or month and day, then time of day; null without year."""
    start = F.make_date(year, F.lit(1), F.lit(1))
    date = F.when(month.isNotNull() & day.isNotNull(), F.date_add(F.add_months(start, month - 1), day - 1)).otherwise(
        F.date_add(start, F.coalesce(julian, F.lit(1)) - 1)
    )
    zero = F.lit(0)
    clock = F.make_dt_interval(zero, F.coalesce(hour, zero), F.coalesce(minute, zero), F.coalesce(second, zero).cast("decimal(18,6)"))
    return date.cast("timestamp_ntz") + clock


def months_apart(start: Column, finish: Column) -> Column:
    """Whole months from ``start`` to the first of ``finish``'s month, toward zero."""
    return F.months_between(F.trunc(finish, "month"), start).cast("int")


def month_series(start: Column, finish: Column) -> Column:
    """The first of each month from that of ``start`` to that of ``finish``."""
    return F.sequence(F.trunc(start, "month"), F.trunc(finish, "month"), F.expr("interval 1 month"))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
