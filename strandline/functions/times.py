"""Event time as microseconds since 1970 (UTC), in plain long arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
WEEK = 7 * DAY

#: 1970-01-05 was the first Monday.
FIRST_MONDAY = 4 * DAY


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of column `name`; a number is taken as is.

    A timestamp without zone is read in the session's zone, which this library pins to UTC.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long") * DAY
    return F.col(name).cast("long")


def floor_to(us: Column, unit: int, origin: int = 0) -> Column:
    """Start of the unit-long slot that holds `us`; right before 1970 as well."""
    shifted = us - F.lit(origin)
    return us - F.pmod(shifted, F.lit(unit))


def bucket(us: Column, interval: str) -> Column:
    """Start of the hour, day, ISO week (Monday) or month, in microseconds."""
    if interval == "hour":
        return floor_to(us, HOUR)
    if interval == "day":
        return floor_to(us, DAY)
    if interval == "week":
        return floor_to(us, WEEK, FIRST_MONDAY)
    if interval == "month":
        day = F.date_from_unix_date(F.floor(us / F.lit(DAY)).cast("int"))
        return F.unix_date(F.trunc(day, "month")).cast("long") * DAY
    raise ValueError(f"unknown interval {interval!r}")


def day_text(us: Column) -> Column:
    """UTC day as 'YYYY-MM-DD'."""
    return F.date_format(F.date_from_unix_date(((us - F.pmod(us, F.lit(DAY))) / F.lit(DAY)).cast("int")), "yyyy-MM-dd")
