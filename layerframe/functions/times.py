"""Column functions over zone-less timestamps.

Everything here stays on ``timestamp_ntz``: built-ins that silently cast to a
zoned timestamp (``date_trunc``, ``unix_micros``) are avoided, so results do
not depend on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEASON_START_MONTH

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval(step: timedelta) -> Column:
    """A day-time interval literal."""
    return F.lit(step)


def step_micros(step: timedelta) -> int:
    return step // timedelta(microseconds=1)


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp."""
    ts = _col(ts)
    seconds = (
        F.unix_date(ts.cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
    )
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def month_start(ts: str | Column) -> Column:
    return F.trunc(_col(ts).cast("date"), "month").cast("timestamp_ntz")


def day_start(ts: str | Column) -> Column:
    return _col(ts).cast("date").cast("timestamp_ntz")


def hour_start(ts: str | Column) -> Column:
    ts = _col(ts)
    return day_start(ts) + F.make_dt_interval(F.lit(0), F.hour(ts))


def season_start_year(ts: str | Column) -> Column:
    """Year in which the season containing ``ts`` began (1 August)."""
    ts = _col(ts)
    return F.year(ts) - F.when(F.month(ts) < SEASON_START_MONTH, 1).otherwise(0)


def season_name(y1: str | Column) -> Column:
    y1 = _col(y1)
    return F.concat_ws("_", y1.cast("string"), (y1 + 1).cast("string"))


def season_order(month: str | Column) -> Column:
    """Sort key that lists months as 8, 9, ..., 12, 1, ..., 7."""
    return F.pmod(_col(month) - SEASON_START_MONTH, F.lit(12))


def iso_string(ts: str | Column) -> Column:
    """ISO text with nanoseconds, the published form of ``time``."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS")


def parse_iso(text: str | Column) -> Column:
    """Inverse of :func:`iso_string`; digits below a microsecond are dropped."""
    return F.substring(_col(text), 1, 26).cast("timestamp_ntz")


def time_of_day(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def year_month(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def month_day(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "MM-dd")


def exceeds_step(earlier: str | Column, later: str | Column, step: timedelta) -> Column:
    """True where two times lie further apart than ``step``."""
    return _col(later) > _col(earlier) + interval(step)


def ntz(value: str | datetime) -> Column:
    """A zone-less timestamp literal."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")
