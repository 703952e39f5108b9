"""Hours, days and civil time on TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def civil_time(ts: Column, zone: Column) -> Column:
    """Local wall-clock time of a UTC time; the zone may differ by row, and a missing zone is UTC."""
    return F.convert_timezone(F.lit("UTC"), F.coalesce(zone, F.lit("UTC")), ts)


def circular(distance: Column) -> Column:
    """On a clock of 24 hours."""
    return F.least(distance, 24 - distance)


def separation(a: Column, b: Column) -> Column:
    """The shorter way round between two hours."""
    return F.least(F.pmod(a - b, F.lit(24)), F.pmod(b - a, F.lit(24)))


def clock_distance(hour: Column, target: float) -> Column:
    return circular(F.abs(hour - F.lit(float(target))))
