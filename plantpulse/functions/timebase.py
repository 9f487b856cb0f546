"""Frequencies, time buckets and timestamp parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MICROS = {
    ("us", "microsecond"): 1,
    ("ms", "millisecond"): 1_000,
    ("s", "sec", "second"): 1_000_000,
    ("min", "t", "minute"): 60_000_000,
    ("h", "hour"): 3_600_000_000,
    ("d", "day"): 86_400_000_000,
    ("w", "week"): 604_800_000_000,
}
_MICROS = {name: micros for names, micros in _UNIT_MICROS.items() for name in names}

# Tried in this order after Spark's own ISO reading; month comes before day.
_CLOCK = "[ H:mm[:ss[.SSSSSSSSS]]]"
TIMESTAMP_FORMATS = (
    *(f"{date}{_CLOCK}" for date in ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "MMM d[,] yyyy", "d MMM yyyy")),
    *(f"{date} h:mm[:ss[.SSSSSSSSS]] a" for date in ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "yyyy/M/d", "MMM d[,] yyyy")),
)


def frequency_micros(frequency: str) -> int:
    """Length in microseconds of a frequency such as ``10min``, ``1H``, ``1T``, ``30sec`` or ``1 hour``."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", frequency)
    if not match:
        raise ValueError(f"not a frequency: {frequency!r}")
    unit = match[2].lower()
    micros = _MICROS.get(unit) or _MICROS.get(unit.removesuffix("s"))
    count = int(match[1] or 1)
    if not micros or not count:
        raise ValueError(f"not a frequency: {frequency!r}")
    return count * micros


def frequency_interval(frequency: str) -> str:
    """The same length as an interval string for ``window`` and ``withWatermark``."""
    return f"{frequency_micros(frequency)} microseconds"


def floor_time(time: Column, frequency: str, origin: Column | None = None) -> Column:
    """Start of the bucket that holds ``time``; buckets are counted from the epoch or ``origin``."""
    step = F.lit(frequency_micros(frequency))
    micros = F.unix_micros(time)
    since = micros if origin is None else micros - F.unix_micros(origin)
    return F.timestamp_micros(micros - F.pmod(since, step))


def parse_timestamp(text: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """Timestamp from text in one of several layouts; text that fits none gives null (see ``unread_timestamps``)."""
    text = F.trim(text)
    # Eight digits are a date, not a year, which Spark's own reading could take them for.
    own = F.when(~text.rlike("^[0-9]{5,}$"), F.try_to_timestamp(text))
    return F.coalesce(own, *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def unread_timestamps(text: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """An aggregate: how many non-blank texts no layout fits."""
    return F.count_if((F.trim(text) != "") & parse_timestamp(text, formats).isNull())


def in_time_range(time: Column, end: Column, length: str) -> Column:
    """True for the last ``length`` (such as ``10min``) up to ``end``, both ends included."""
    span = F.make_dt_interval(secs=F.lit(frequency_micros(length) / 1_000_000))
    return time.between(end - span, end)
