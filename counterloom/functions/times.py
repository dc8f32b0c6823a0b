"""Time buckets, calendar keys and report periods."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_s(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def group_date(ts: Column, minutes: int = 15) -> Column:
    """Start of the ``minutes``-wide bucket; buckets restart at every full hour."""
    if not 1 <= minutes <= 60:
        raise ValueError("a bucket is 1 to 60 minutes wide; days and weeks are for bucket()")
    sec = F.unix_timestamp(ts)
    width = 60 * minutes
    in_hour = F.pmod(sec, F.lit(3600))
    return F.timestamp_seconds(sec - F.pmod(in_hour, F.lit(width)))


def bucket(ts: Column, unit: str) -> Column:
    """Start of the hour, day, ISO week or month."""
    return F.date_trunc(unit, ts)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def iso_year(ts: Column) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), ts).cast("int")


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def week_key(ts: Column) -> Column:
    """ISO year and week, ``iyyyiw``."""
    return F.format_string("%04d%02d", iso_year(ts), iso_week(ts))


def is_weekday(ts: Column) -> Column:
    """Monday to Friday."""
    return F.dayofweek(ts).between(2, 6)


def release_label(ts: Column) -> Column:
    """Release name of the ISO week: ``rYY_00_WW``."""
    return F.format_string("r%s_00_%02d", F.date_format(ts, "yy"), iso_week(ts))


def elapsed_s(ts: Column, previous: Column) -> Column:
    return (F.unix_micros(ts) - F.unix_micros(previous)) / F.lit(1e6)


def period(as_of: datetime, unit: str) -> tuple[datetime, datetime]:
    """The last complete hour or day before ``as_of``, as a half-open range."""
    if unit == "hour":
        end = as_of.replace(minute=0, second=0, microsecond=0)
        return end - timedelta(hours=1), end
    if unit == "day":
        end = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
        return end - timedelta(days=1), end
    raise ValueError(f"unknown period unit: {unit}")
