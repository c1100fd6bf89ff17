"""Text expressions: E1 pattern mask, F4 literal search, E10 redaction, E11 stack cut,
E12 request summary, E13 e-mail mask, E14 key mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern mining looks at the first 100 characters, digit runs become '*'.
PATTERN_PREFIX_CHARS = 100
# Query-string parameters whose values are masked, case-insensitive.
SECRET_PARAM_REGEX = r"(?i)(apiKey|token|key|secret)=[^&]*"
SECRET_REPLACEMENT = "$1=***"
# Stack traces keep 5 lines, then this marker.
STACK_KEEP_LINES = 5
STACK_MARKER = "\n... (truncated)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pattern_mask(message="message", prefix_chars: int | None = PATTERN_PREFIX_CHARS) -> Column:
    """Cut to the first ``prefix_chars`` characters (``None``: the whole message), then
    replace every digit run with ``*``."""
    text = _col(message) if prefix_chars is None else F.substring(_col(message), 1, prefix_chars)
    return F.regexp_replace(text, "[0-9]+", "*")


def contains_ci(col, needle: str) -> Column:
    """case-insensitive *literal* substring test. ``%`` and ``_`` in ``needle`` are
    ordinary characters (no LIKE escaping needed)."""
    return F.lower(_col(col)).contains(needle.lower())


def redact_secrets(query="request_path") -> Column:
    """Mask values of apiKey/token/key/secret parameters."""
    return F.regexp_replace(_col(query), SECRET_PARAM_REGEX, SECRET_REPLACEMENT)


def cut_stack(text="exception") -> Column:
    """More than 5 lines -> first 5 lines plus a truncation marker; null stays null."""
    x = _col(text)
    return F.when(
        F.size(F.split(x, "\n")) > STACK_KEEP_LINES,
        F.concat(F.substring_index(x, "\n", STACK_KEEP_LINES), F.lit(STACK_MARKER)),
    ).otherwise(x)


def request_summary(method="request_method", path="request_path", status="status_code", duration="duration_ms") -> Column:
    """``METHOD path -> status (Nms)`` with whole milliseconds; null parts are empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        part(_col(method)),
        F.lit(" "),
        part(_col(path)),
        F.lit(" -> "),
        part(_col(status)),
        F.lit(" ("),
        part(F.floor(_col(duration)).cast("bigint")),
        F.lit("ms)"),
    )


def mask_email(email="email") -> Column:
    """``@`` missing or within the first two characters -> ``***@***``; otherwise first
    character + ``***@`` + domain."""
    e = _col(email)
    at = F.instr(e, "@")
    return F.when(at <= 2, F.lit("***@***")).otherwise(
        F.concat(F.substring(e, 1, 1), F.lit("***@"), e.substr(at + 1, F.length(e)))
    )


def mask_key(key="api_key") -> Column:
    """Keys longer than 12 characters show the first 8 and last 4."""
    k = _col(key)
    return F.when(
        F.length(k) > 12,
        F.concat(F.substring(k, 1, 8), F.lit("..."), k.substr(F.length(k) - 3, F.lit(4))),
    ).otherwise(k)
