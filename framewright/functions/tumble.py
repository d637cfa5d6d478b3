"""TUMBLE: the start of the epoch-anchored window that holds a timestamp."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

_UNITS = {"millisecond": 1, "ms": 1, "second": 1000, "s": 1000, "minute": 60_000, "m": 60_000, "hour": 3_600_000, "day": 86_400_000}


def width_ms(width: str | int | timedelta) -> int:
    """Window width in whole milliseconds, from '5 minutes', a number of milliseconds or a timedelta."""
    if isinstance(width, timedelta):
        ms = width.days * 86_400_000 + width.seconds * 1000 + width.microseconds // 1000
    elif isinstance(width, int):
        ms = width
    else:
        found = re.fullmatch(r"\s*([-+]?\d+(?:\.\d+)?)\s*([a-zA-Z]+?)s?\s*", width)
        unit = found and found[2].lower()
        if unit in ("month", "year", "quarter"):
            raise EngineError("INVALID_PARAMETER", "a TUMBLE interval cannot contain calendar months")
        if not found or (unit not in _UNITS and unit != ""):
            raise EngineError("INVALID_PARAMETER", f"not an interval: {width!r}")
        ms = int(float(found[1]) * _UNITS[unit])
    if ms <= 0:
        raise EngineError("INVALID_PARAMETER", "a TUMBLE interval must be positive")
    return ms


def tumble(ts: Column, width: str | int | timedelta) -> Column:
    """Start of the window of this width that holds ts, counted from the epoch, floors before it too. Null for null.

    Timestamps with or without a zone; the result is a timestamp in the session's zone.
    """
    ms = width_ms(width)
    at = F.unix_millis(ts.cast("timestamp"))
    return F.timestamp_millis(at - F.pmod(at, F.lit(ms)))


def date_bin(width: str | int | timedelta, ts: Column, origin: Column | None = None) -> Column:
    """Start of the bin of this width, counted from an origin (the epoch by default), in microseconds."""
    us = width_ms(width) * 1000
    zero = F.lit(0) if origin is None else F.unix_micros(origin.cast("timestamp"))
    at = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at - zero, F.lit(us)))
