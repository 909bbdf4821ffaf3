"""Timestamps without a zone, and day differences that count midnights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_timestamp(value: Column) -> Column:
    """Text or timestamp to a zone-less timestamp; unreadable text raises under ANSI mode."""
    return value.cast("timestamp_ntz")


def calendar_days(start: Column, end: Column) -> Column:
    """Midnights crossed between two instants (23:00 to 01:00 is 1), as BIGINT.

    ``timestampdiff(DAY, ...)`` counts full 24-hour spans and would give 0 there.
    """
    return F.datediff(end, start).cast("bigint")
