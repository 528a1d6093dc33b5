"""Instants. The present is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc822(c: Column) -> Column:
    """Instant of a feed's date, such as `Tue, 02 Jan 2024 10:00:00 GMT`; null if it can't be read."""
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")))


def epoch(c: Column) -> Column:
    """Instant of positive epoch seconds, else null."""
    return F.when(c > 0, F.timestamp_seconds(c))


def resolve(published: Column, updated: Column, now: Column, ahead_hours: int = 24) -> Column:
    """First instant known; now if there is none or it lies too far ahead."""
    got = F.coalesce(published, updated, now)
    return F.when(got > now + F.expr(f"INTERVAL {ahead_hours} HOURS"), now).otherwise(got)


def hours_between(a: Column, b: Column) -> Column:
    """Absolute difference in hours, fractions kept."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) / F.lit(3.6e9)


def recency(published: Column, now: Column, hours: float = 48.0) -> Column:
    """1 for now or later, falling to 0 at the given age."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (micros(now) - micros(published)) / F.lit(3.6e9)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - age / F.lit(hours)))


def short_date(c: Column) -> Column:
    return F.date_format(c, "MMM d, yyyy")


def stamp(c: Column) -> Column:
    return F.date_format(c, "MMM d, yyyy, h:mm a")
