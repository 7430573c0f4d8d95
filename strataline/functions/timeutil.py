"""Times and durations, for Python values and as columns; durations are whole nanoseconds."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds of each suffix. (fixed values)
NANOS = {
    "ns": 1, "us": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "sec": 10**9, "m": 60 * 10**9, "min": 60 * 10**9,
    "h": 3600 * 10**9, "hr": 3600 * 10**9, "hour": 3600 * 10**9, "D": 86400 * 10**9, "d": 86400 * 10**9, "day": 86400 * 10**9, "W": 7 * 86400 * 10**9,
}
_DURATION = re.compile(r"\s*([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)\s*([A-Za-zμ]+)\s*\Z")


def to_time(value) -> datetime | None:
    """A time in UTC from ISO text, epoch seconds or a datetime; None stays None."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    if isinstance(value, bool):
        raise TypeError("not a time")
    if isinstance(value, int | float):
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=round(value * 1e6))
    if isinstance(value, str):
        return to_time(datetime.fromisoformat(value))
    raise TypeError(f"not a time: {type(value).__name__}")


def to_nanos(value, unit: str = "s") -> int | None:
    """A duration from a number and unit, text such as 1.5h, or a timedelta."""
    if value is None:
        return None
    if isinstance(value, timedelta):
        return (value.days * 86400 + value.seconds) * 10**9 + value.microseconds * 1000
    if isinstance(value, str):
        m = _DURATION.match(value)
        if not m or m[2] not in NANOS:
            raise ValueError(f"not a duration: {value}")
        value, unit = float(m[1]), m[2]
    if unit not in NANOS:
        raise ValueError(f"unknown unit {unit}")
    return round(value * NANOS[unit])


def to_float(value, unit: str = "s", reference: datetime | None = None) -> float:
    """A duration, or the time since ``reference`` (the epoch), in a unit."""
    if unit not in NANOS:
        raise ValueError(f"unknown unit {unit}")
    if isinstance(value, datetime):
        value = to_time(value) - (to_time(reference) or datetime(1970, 1, 1, tzinfo=UTC))
    return to_nanos(value) / NANOS[unit]


def time_column(value: Column, kind: str) -> Column:
    """ISO text (kind string) or epoch seconds as timestamp."""
    return F.to_timestamp(value) if kind == "string" else F.timestamp_micros(F.round(value.cast("double") * 1e6).cast("long"))


def nanos_column(text: Column) -> Column:
    """Duration text such as 500ms as nanoseconds; NULL if it is none."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*[A-Za-zμ]+\s*$", 1).try_cast("double")
    suffix = F.regexp_extract(text, r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*([A-Za-zμ]+)\s*$", 1)
    table = F.create_map(*[F.lit(x) for pair in NANOS.items() for x in pair])
    return F.round(number * F.try_element_at(table, suffix)).cast("long")
