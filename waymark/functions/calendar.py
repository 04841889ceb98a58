"""Calendar columns of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_ZERO = "2012-01-01"


def centi_hour(ts: Column) -> Column:
    """Hour of day with minutes as a fraction, in hundredths, half to even (0..2398)."""
    return (F.hour(ts) * 100 + F.rint(F.minute(ts) * 100 / F.lit(60.0))).cast("bigint")


def hour_of_week(ts: Column) -> Column:
    """Whole hours since Monday 00:00."""
    return (F.weekday(ts) * 24 + F.hour(ts)).cast("bigint")


def weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("bigint")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days, null when ``end`` is null."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(86400.0)


def week_serial(date: Column) -> Column:
    """Whole weeks since 2012-01-01."""
    return F.floor(F.datediff(date, F.lit(WEEK_ZERO).cast("date")) / 7)


def week_start(serial: Column) -> Column:
    """First day of a week serial."""
    return F.date_add(F.lit(WEEK_ZERO).cast("date"), (serial * 7).cast("int"))


def monday(date: Column) -> Column:
    """Monday on or before."""
    return F.date_sub(date, F.weekday(date))


def sunday(date: Column) -> Column:
    """Sunday on or after."""
    return F.date_add(date, F.lit(6) - F.weekday(date))


def first_sunday_months_back(date: Column, months: int) -> Column:
    """First of the month ``months`` earlier, moved to the Sunday on or after."""
    return sunday(F.trunc(F.add_months(date, -months), "month"))


def text_to_timestamp(text: Column) -> Column:
    """Parse ``yyyy-MM-dd HH:mm:ss`` cut to any of its leading parts; null when it does not parse."""
    full = F.concat(text, F.substring(F.lit("0000-01-01 00:00:00"), F.length(text) + 1, F.lit(19)))
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss"))
