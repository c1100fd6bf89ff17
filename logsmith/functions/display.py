"""Display expressions: E15 (key expiry status), E17 (status class), E20 (display name)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsmith.functions.time import ts_lit

# Keys within this many days of expiry are flagged.
EXPIRY_WARNING_DAYS = 7


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display_name(project="project_name", app="app_name") -> Column:
    """Project name, else app name."""
    return F.coalesce(F.nullif(_col(project), F.lit("")), _col(app))


def status_class(status="status_code") -> Column:
    """5xx / 4xx / 2xx / other."""
    s = _col(status)
    return (
        F.when(s >= 500, F.lit("5xx"))
        .when(s >= 400, F.lit("4xx"))
        .when((s >= 200) & (s < 300), F.lit("2xx"))
        .otherwise(F.lit("other"))
    )


def days_left(expires="expires_at", as_of=None) -> Column:
    """Whole days until expiry, truncated toward zero (null when the key never expires)."""
    micros = F.timestamp_diff("MICROSECOND", ts_lit(as_of), _col(expires))
    return (micros / F.lit(86400000000.0)).cast("int")


def is_expired(expires="expires_at", as_of=None) -> Column:
    """A key is expired when its expiry lies strictly before ``as_of``."""
    e = _col(expires)
    return e.isNotNull() & (e < ts_lit(as_of))


def expiry_status(expires="expires_at", as_of=None) -> dict[str, Column]:
    """Status text, days left, warning flag and the label shown next to a key."""
    e = _col(expires)
    expired = is_expired(e, as_of)
    left = days_left(e, as_of)
    date_txt = F.date_format(e, "yyyy-MM-dd")
    label = (
        F.when(e.isNull(), F.lit("Never"))
        .when(expired, F.concat(F.lit("Expired "), date_txt))
        .otherwise(F.concat(date_txt, F.lit(" ("), left.cast("string"), F.lit("d left)")))
    )
    warning = (~expired) & e.isNotNull() & (
        F.timestamp_diff("MICROSECOND", ts_lit(as_of), e) < F.lit(EXPIRY_WARNING_DAYS * 86400000000)
    )
    return {
        "status": F.when(expired, F.lit("Expired")).otherwise(F.lit("Active")),
        "days_left": left,
        "expiry_warning": F.coalesce(warning, F.lit(False)),
        "expiry_label": label,
    }
