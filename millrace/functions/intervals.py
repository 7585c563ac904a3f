"""Intervals such as ``"2h"`` or ``"30 days"``, and time arithmetic on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each unit, with its spellings.
UNITS = {
    "second": (1, ("s", "sec", "secs", "second", "seconds")),
    "minute": (60, ("m", "min", "mins", "minute", "minutes")),
    "hour": (3600, ("h", "hr", "hrs", "hour", "hours")),
    "day": (86400, ("d", "day", "days")),
}
_BY_NAME = {name: (unit, seconds) for unit, (seconds, names) in UNITS.items() for name in names}
#: Stands for a window without a beginning.
LIFETIME = -1


def parse_interval(text: str) -> int:
    """Seconds; LIFETIME for "lifetime". Months, years and weeks have no fixed meaning here and raise."""
    count, unit = split_interval(text)
    return LIFETIME if unit == "lifetime" else count * UNITS[unit][0]


def split_interval(text: str) -> tuple[int, str]:
    """Count and unit name."""
    if text.strip().lower() == "lifetime":
        return LIFETIME, "lifetime"
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", text)
    if not m or m[2].lower() not in _BY_NAME:
        raise ValueError(f"not an interval: {text!r} (expected a number and seconds, minutes, hours or days)")
    return int(m[1]), _BY_NAME[m[2].lower()][0]


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970, cut down to whole ones, of a timestamp without time zone, whatever the session's zone."""
    return _floor_div(F.shiftright(micros_of(ts), 6), 15_625, 1 << 58)  # a second is 64 times 15,625 microseconds


def _floor_div(x: Column, by: int, least: int) -> Column:
    """Whole part, rounded down, of x / by, for longs from -least on.

    x is named once: slices of slices, and the filters that Spark derives from
    them, would double with each mention.
    """
    up = -(-least // by)
    return F.call_function("div", x + F.lit(up * by), F.lit(by).cast("long")) - F.lit(up)


def from_seconds(s: Column) -> Column:
    """The timestamp without time zone of seconds since 1970."""
    return F.timestamp_add("SECOND", s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def slice_start(ts: Column, seconds: int) -> Column:
    """Start, in seconds since 1970, of the slice that holds ``ts``; slices are aligned to 1970."""
    return _floor_div(seconds_of(ts), seconds, 10**13) * F.lit(seconds).cast("long")


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
