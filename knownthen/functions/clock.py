"""Microsecond time arithmetic.

Windows and panes work on epoch microseconds, so half-open edges are exact integers
and every trailing width is a plain offset.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

DAY = timedelta(days=1)


def width_us(width: timedelta) -> int:
    return width // timedelta(microseconds=1)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def instant(us: Column | str) -> Column:
    return F.timestamp_micros(F.col(us) if isinstance(us, str) else us)


def at(ts: datetime) -> Column:
    """A timestamp literal; naive values are read as UTC."""
    if ts.tzinfo is None:
        ts = ts.replace(tzinfo=timezone.utc)
    return F.lit(ts)


def before(ts: Column | str, width: timedelta) -> Column:
    return instant(micros(ts) - F.lit(width_us(width)))


def after(ts: Column | str, width: timedelta) -> Column:
    return instant(micros(ts) + F.lit(width_us(width)))


def pane_of(us: Column, width: timedelta) -> Column:
    """Number of the fixed-width pane an instant falls in (floor, also before 1970)."""
    step = F.lit(width_us(width))
    return F.call_function("div", us - F.pmod(us, step), step)


def utc_day(ts: Column | str) -> Column:
    """Start of the UTC day of a timestamp, independent of the session time zone."""
    us = micros(ts)
    return instant(us - F.pmod(us, F.lit(width_us(DAY))))
