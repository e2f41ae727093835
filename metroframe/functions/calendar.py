"""Times of day, buckets and steps of the calendar as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The slots of a day with their first hour and the one after their last; the first one goes over midnight.
SLOTS = (("凌晨", 23, 7), ("早高峰", 7, 9), ("上午", 9, 11), ("午间", 11, 13), ("下午", 13, 17), ("晚高峰", 17, 19), ("夜间", 19, 23))
BUCKETS = {"hour": "yyyy-MM-dd'T'HH:00:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def in_hours(hour: Column, start: int, end: int) -> Column:
    """From start up to, not including, end; over midnight if start is the later one."""
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def day_slot(hour: Column) -> Column:
    found = F.lit(SLOTS[0][0])
    for name, start, end in SLOTS[1:]:
        found = F.when(in_hours(hour, start, end), F.lit(name)).otherwise(found)
    return found


def is_night(ts: Column, end_inclusive: bool = False) -> Column:
    """From 22 to 6 o'clock. Screening counts the hour from 6 to 7, all else does not."""
    return (F.hour(ts) >= 22) | (F.hour(ts) < (7 if end_inclusive else 6))


def bucket(ts: Column, width: str) -> Column:
    """The hour, day or month of a time as text; 'all' for any other width, 'unknown' without a time."""
    made = F.date_format(ts, BUCKETS[width]) if width in BUCKETS else F.when(ts.isNotNull(), F.lit("all"))
    return F.coalesce(made, F.lit("unknown"))


def hour_of(ts: Column, hour: Column) -> Column:
    """The hour of a time that may be text; where that can't be read, a column of hours if it has 0 to 23."""
    spare = hour.cast("string").try_cast("int")
    return F.coalesce(F.hour(ts.try_cast("timestamp")), F.when(spare.between(0, 23), spare))


def advance(ts: Column, unit: str, steps: Column) -> Column:
    """So many hours, days or months later; a month without the day ends earlier."""
    if unit == "month":
        return F.add_months(ts, steps).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + steps * {"hour": 3_600_000_000, "day": 86_400_000_000}[unit])
