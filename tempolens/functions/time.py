"""Time helpers (A07-A11, A60).  All return Columns, evaluated JVM-side.

Timestamps of the source tables are ``timestamp_ntz``.  Every helper that
produces a timestamp returns ``timestamp_ntz`` as well, so results keep the
wall-clock meaning of the input regardless of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# Unit names of the reference's time pickers mapped to date_trunc units.
TRUNC_UNITS = {"SS": "second", "MI": "minute", "HH24": "hour", "DD": "day",
               "WW": "week", "MM": "month", "YYYY": "year"}


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    """``end - start`` in (fractional) seconds, like Oracle DATE arithmetic * 86400."""
    s, e = as_col(start), as_col(end)
    return (F.unix_micros(e.cast("timestamp")) - F.unix_micros(s.cast("timestamp"))) / F.lit(1_000_000.0)


def time_bucket(ts, seconds: int) -> Column:
    """Start of the ``seconds``-wide slot within the day that contains ``ts``.

    Slots restart at midnight, so widths that do not divide a day still line
    up with the calendar day: day start + floor(second of day / n) * n.
    """
    t = as_col(ts)
    day = F.date_trunc("day", t)
    sod = F.unix_seconds(t.cast("timestamp")) - F.unix_seconds(day)
    start = F.unix_seconds(day) + F.floor(sod / F.lit(seconds)) * F.lit(seconds)
    return _ntz(F.timestamp_seconds(start))


def trunc_time(ts, unit: str) -> Column:
    """Truncate to a named unit: SS, MI, HH24, DD, WW, MM, YYYY."""
    u = TRUNC_UNITS.get(unit.upper(), unit)
    return _ntz(F.date_trunc(u, as_col(ts)))


def minute_slice(minute_no, width: int) -> Column:
    """``m - mod(m, width)``: start of the width-minute slice of a minute number."""
    m = as_col(minute_no)
    return m - F.pmod(m, F.lit(width))


def round_time(ts, unit: str = "MI") -> Column:
    """Round to the *nearest* unit (Oracle ROUND(ts,'MI')) (A10)."""
    half = {"MI": "30 seconds", "HH24": "30 minutes", "SS": "500 milliseconds"}[unit.upper()]
    return _ntz(F.date_trunc(TRUNC_UNITS[unit.upper()], as_col(ts) + F.expr(f"INTERVAL {half}")))


def overlaps(begin, end, start, stop) -> Column:
    """Interval [begin, end] overlaps the selection [start, stop]: begin < stop AND end >= start."""
    return (as_col(begin) < as_col(stop)) & (as_col(end) >= as_col(start))


# Input masks accepted by the reference's time selection, by locale.
TIME_MASKS = {"de": ["dd.MM.yyyy HH:mm", "dd.MM.yyyy"], "en": ["yyyy-MM-dd HH:mm", "yyyy-MM-dd"]}


def parse_time(text, locale: str = "en") -> Column:
    """Strict parse of a time-selection string; NULL when no mask fits."""
    t = F.trim(as_col(text))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(m)).cast("timestamp_ntz")
                        for m in TIME_MASKS[locale]])
