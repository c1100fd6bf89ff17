"""Time expressions on ``TIMESTAMP_NTZ``: literals, truncation to ms / s / minute, the month
key (E18), relative age (E16) and the dashboard time presets (F11).

Truncation is done with ``timestampdiff`` / ``timestampadd`` against the epoch, which keeps
the type ``TIMESTAMP_NTZ`` and makes results independent of the session time zone
(``date_trunc`` would return a zoned ``TIMESTAMP``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_SQL = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_datetime(value) -> dt.datetime:
    """Driver-side parameter -> naive UTC datetime (accepts ``datetime``, ``date`` or ISO text;
    a value with an offset is converted to UTC, one without is UTC)."""
    if not isinstance(value, dt.datetime):
        if isinstance(value, dt.date):
            return dt.datetime(value.year, value.month, value.day)
        value = dt.datetime.fromisoformat(str(value))
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def fmt_ts(value) -> str:
    d = as_datetime(value)
    return d.strftime("%Y-%m-%d %H:%M:%S") + (f".{d.microsecond:06d}" if d.microsecond else "")


def ts_lit(value) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (string -> NTZ cast is zone-free and constant-folded, so
    comparisons against it reach the Parquet scan as pushed filters)."""
    return F.lit(fmt_ts(value)).cast(T.TimestampNTZType())


def _trunc(c, unit: str, div: int) -> Column:
    return F.expr(
        f"timestampadd({unit}, floor(timestampdiff(MICROSECOND, {EPOCH_SQL}, {c}) / {div}), {EPOCH_SQL})"
    )


def to_ms(col="timestamp") -> Column:
    """Truncate to milliseconds (storage precision of ``logs.timestamp``)."""
    name = col if isinstance(col, str) else None
    if name is None:
        raise TypeError("to_ms expects a column name")
    return _trunc(f"`{name}`", "MILLISECOND", 1000)


def to_second(col="timestamp") -> Column:
    return _trunc(f"`{col}`", "SECOND", 1000000)


def to_minute(col="timestamp") -> Column:
    return _trunc(f"`{col}`", "MINUTE", 60000000)


def truncate_second(value) -> dt.datetime:
    """F9 on the driver: filter bounds are whole seconds."""
    return as_datetime(value).replace(microsecond=0)


def truncate_minute(value) -> dt.datetime:
    return as_datetime(value).replace(second=0, microsecond=0)


def month_key(col="timestamp") -> Column:
    """``yyyymm`` as INT (the partition key of the stored tables)."""
    c = _col(col)
    return (F.year(c) * 100 + F.month(c)).cast("int")


def month_of(value) -> int:
    d = as_datetime(value)
    return d.year * 100 + d.month


def relative_age(col="timestamp", as_of=None) -> Column:
    """Whole seconds since ``col`` at ``as_of`` rendered as ``Ns/Nm/Nh/Nd ago`` (floor)."""
    secs = F.timestamp_diff("SECOND", _col(col), ts_lit(as_of))
    return (
        F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago")))
        .when(secs < 3600, F.concat(F.floor(secs / 60).cast("string"), F.lit("m ago")))
        .when(secs < 86400, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(secs / 86400).cast("string"), F.lit("d ago")))
    )


# Dashboard presets in hours; 0 means no time bound.
TIME_PRESETS_HOURS = (1, 6, 24, 168, 0)


def preset_range(as_of, hours: int) -> tuple[dt.datetime | None, dt.datetime | None]:
    """preset -> (from, to), both cut to the minute; ``hours == 0`` -> no bounds."""
    if hours not in TIME_PRESETS_HOURS:
        raise ValueError(f"unknown preset {hours}h; expected one of {TIME_PRESETS_HOURS}")
    if hours == 0:
        return None, None
    now = as_datetime(as_of)
    return truncate_minute(now - dt.timedelta(hours=hours)), truncate_minute(now)
