"""Hour buckets, clock parts and text keys on zone-free timestamps.

Everything stays in TIMESTAMP_NTZ: no expression here passes through a zoned
timestamp, so the session zone and its clock changes cannot move a record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailgrid.functions.grid import _as_col

# Text formats of the ride files and of the weather files.
RIDE_TIME = "yyyy-MM-dd HH:mm:ss"
WEATHER_TIME = "yyyy-MM-dd HH:mm"


def parse_time(c: Column | str, fmt: str, strict: bool = True) -> Column:
    """Text to timestamp. ``strict`` fails on text that is not in the format or is no time, otherwise it gives null.

    The lenient form takes the formats above: digits in place of the letters, in the order that a plain cast reads.
    """
    if strict:
        return F.to_timestamp_ntz(_as_col(c), F.lit(fmt))
    if not RIDE_TIME.startswith(fmt):
        raise ValueError(f"no lenient parse for {fmt}")
    shape = "^" + re.sub("[yMdHms]", r"\\d", fmt) + "$"
    return F.when(_as_col(c).rlike(shape), _as_col(c).try_cast("timestamp_ntz"))


def hour_floor(c: Column | str) -> Column:
    ts = _as_col(c)
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def week_floor(c: Column | str) -> Column:
    return F.trunc(_as_col(c).cast("date"), "week").cast("timestamp_ntz")


def half_month_floor(c: Column | str) -> Column:
    """The first or the sixteenth of the month."""
    day = _as_col(c).cast("date")
    first = F.trunc(day, "month")
    return F.when(F.dayofmonth(day) < 16, first).otherwise(F.date_add(first, 15)).cast("timestamp_ntz")


def month_floor(c: Column | str) -> Column:
    return F.trunc(_as_col(c).cast("date"), "month").cast("timestamp_ntz")


def weekday(c: Column | str) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(_as_col(c))


def _text(c: Column | str, start: int, length: int) -> Column:
    return F.substring(_as_col(c).cast("string"), start, length)


def hour_key(c: Column | str) -> Column:
    """``YYYY-MM-DD-HH``."""
    return F.translate(_text(c, 1, 13), " ", "-")


def month_day(c: Column | str) -> Column:
    """``MM/DD``."""
    return F.translate(_text(c, 6, 5), "-", "/")


def period_label(c: Column | str) -> Column:
    """``YYYY-MM``."""
    return _text(c, 1, 7)


def period_date(label: Column | str) -> Column:
    """First day of a ``YYYY-MM`` label."""
    return F.to_date(_as_col(label), "yyyy-MM")


def hour_key_from_text(c: Column | str) -> Column:
    """Hour key cut from timestamp text without parsing it."""
    return F.regexp_replace(F.substring(_as_col(c), 1, 13), r"\s+", "-")


def with_weekday_hour(df, c: str = "pickup_datetime"):
    return df.withColumns({"weekday": weekday(c), "hour": F.hour(c)})


def micros(t: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free time, whatever the session's zone."""
    t = F.col(t) if isinstance(t, str) else t
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return days * 86_400_000_000 + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + seconds
