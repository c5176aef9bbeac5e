"""Time buckets and flexible time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("hour", "day", "week", "month", "quarter", "year")

# Time formats that are understood, in the order they are tried.
TIME_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM"]


def bucket(c: Column, granularity: str, week_start: str = "sunday", year_as_date: bool = False) -> Column:
    """Start of the hour (a timestamp), day, week, month or quarter (dates); the year as number, or its first day."""
    if granularity == "hour":
        return F.date_trunc("hour", c)
    day = c.cast("date")
    if granularity == "day":
        return day
    if granularity == "week":
        back = F.dayofweek(day) - 1 if week_start == "sunday" else F.weekday(day)
        return F.date_sub(day, back)
    if granularity == "month":
        return F.trunc(day, "month")
    if granularity == "quarter":
        return F.trunc(day, "quarter")
    if granularity == "year":
        return F.trunc(day, "year") if year_as_date else F.year(day)
    raise ValueError(f"unknown granularity {granularity!r}")


def parse_time(c: Column) -> Column:
    """Timestamp of a text: ISO 8601 with or without zone, ``TIME_FORMATS``, or epoch seconds or milliseconds."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    epoch = F.when((number >= 1e9) & (number < 1e12), F.timestamp_micros((number * 1_000_000).cast("bigint"))).when((number >= 1e12) & (number < 1e15), F.timestamp_micros((number * 1_000).cast("bigint")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS], epoch)
