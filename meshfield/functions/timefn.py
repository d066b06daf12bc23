"""Dates: CF units, time zone offsets, shifts. Axis values are TIMESTAMP_NTZ; offsets are metadata."""

from __future__ import annotations

import re
import warnings
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of the units of "UNIT since EPOCH".
UNITS = {"microsecond": 1, "millisecond": 1_000, "msec": 1_000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000, "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000, "day": 86_400_000_000, "d": 86_400_000_000}


def micros(t: Column) -> Column:
    """Microseconds of a timestamp since 1970."""
    return F.unix_micros(t.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def parse_units(units: str) -> tuple[int, datetime]:
    """(microseconds of the unit, epoch) of CF time units; a zone is left out of the epoch."""
    m = re.match(r"\s*(\w+?)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T\s]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?)?", units)
    if not m or m[1].lower() not in UNITS:
        raise ValueError(f"time units not understood: {units}")
    parts = [int(x or 0) for x in m.groups()[1:7]]
    return UNITS[m[1].lower()], datetime(*parts, int((m[8] or "0")[:6].ljust(6, "0")))


def decode(value: Column, units: str) -> Column:
    """CF time values as timestamps (T-01)."""
    size, epoch = parse_units(units)
    start = int((epoch - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    return from_micros(F.round(value * size).cast("long") + F.lit(start))


def parse_offset(units: str) -> tuple[float | None, str | None]:
    """Hours and name of the zone in CF time units (T-02): (None, None) without one, and with a warning where it cannot be read."""
    tail = re.sub(r"^.*since\s+", "", units.strip(), flags=re.I)
    m = re.match(r"\d{1,4}-\d{1,2}-\d{1,2}(?:[T\s]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\s*(.*)$", tail)
    zone = m[1].strip() if m else None
    if zone in ("naive", "None"):
        return None, None
    if zone in ("Z", "UTC", "GMT") or zone is not None and zone in ("+00:00", "-00:00", "+0:00"):
        return 0.0, "UTC"
    if zone == "":
        return None, None
    z = re.match(r"([+\-−])(\d{1,2}):?(\d{2})?$", zone or "")
    if not z:
        warnings.warn(f"time offset not understood: {units}", stacklevel=2)
        return None, None
    hours = int(z[2]) + int(z[3] or 0) / 60
    hours = hours if z[1] == "+" else -hours
    return hours, offset_text(hours)


def offset_text(hours: float | None) -> str:
    """+HH:MM (T-03); nothing for None."""
    if hours is None:
        return ""
    minutes = round(abs(hours) * 60)
    return f"{'-' if hours < 0 else '+'}{minutes // 60:02d}:{minutes % 60:02d}"


def offset_column(hours: Column) -> Column:
    minutes = F.round(F.abs(hours) * 60).cast("int")
    return F.when(hours.isNull(), "").otherwise(F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0")))


def shifted(t: Column, hours: float) -> Column:
    """T-06"""
    return from_micros(micros(t) + F.lit(round(hours * 3_600_000_000)))


def to_zone(t: Column, old: float | None, new: float | None) -> Column:
    """T-05: from one offset to another; where either is None only the label changes."""
    return t if old is None or new is None else shifted(t, new - old)


def with_origin(t: Column, first: datetime, origin: datetime) -> Column:
    """T-04: times moved so that first falls on origin."""
    return from_micros(micros(t) + F.lit(round((origin - first) / timedelta(microseconds=1))))
