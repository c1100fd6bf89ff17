"""Column expressions (section 2.7 of the survey). All are Spark built-ins, so they stay
inside whole-stage codegen; none is a Python UDF."""

from logsmith.functions.levels import level_code, parse_level, level_short, level_from_status
from logsmith.functions.text import (
    pattern_mask,
    redact_secrets,
    cut_stack,
    request_summary,
    mask_email,
    mask_key,
    contains_ci,
)
from logsmith.functions.time import ts_lit, to_ms, to_second, to_minute, month_key, relative_age
from logsmith.functions.json import metadata_text, metadata_display, metadata_field
from logsmith.functions.display import display_name, status_class, expiry_status

__all__ = [
    "level_code",
    "parse_level",
    "level_short",
    "level_from_status",
    "pattern_mask",
    "redact_secrets",
    "cut_stack",
    "request_summary",
    "mask_email",
    "mask_key",
    "contains_ci",
    "ts_lit",
    "to_ms",
    "to_second",
    "to_minute",
    "month_key",
    "relative_age",
    "metadata_text",
    "metadata_display",
    "metadata_field",
    "display_name",
    "status_class",
    "expiry_status",
]
