"""Table schemas, the level scale and schema evolution.

Schemas are declared, never inferred. Timestamps are ``TIMESTAMP_NTZ`` so results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ordered log level scale (name, code).
LEVELS = (
    ("Trace", 0),
    ("Debug", 1),
    ("Info", 2),
    ("Warning", 3),
    ("Error", 4),
    ("Fatal", 5),
)
LEVEL_NAMES = tuple(name for name, _ in LEVELS)
LEVEL_CODE = dict(LEVELS)

# Request-log levels are free strings, not the scale above.
APP_LOG_LEVELS = ("Information", "Warning", "Error")

_S = T.StringType()
_TS = T.TimestampNTZType()

LOGS_SCHEMA = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("timestamp", _TS, False),
        T.StructField("level", _S, False),
        T.StructField("app_name", _S, False),
        T.StructField("message", _S, False),
        T.StructField("metadata", _S, True),
        T.StructField("exception_type", _S, True),
        T.StructField("exception_message", _S, True),
        T.StructField("exception_stacktrace", _S, True),
        T.StructField("source", _S, True),
        T.StructField("request_method", _S, True),
        T.StructField("request_path", _S, True),
        T.StructField("status_code", T.IntegerType(), True),
        T.StructField("duration_ms", T.DoubleType(), True),
        T.StructField("user_id", _S, True),
        T.StructField("trace_id", _S, True),
        T.StructField("span_id", _S, True),
        T.StructField("host", _S, True),
        T.StructField("environment", _S, True),
        T.StructField("project_id", _S, True),
        T.StructField("project_name", _S, True),
        T.StructField("created_at", _TS, True),
    ]
)

# Stored layout adds the partition column.
LOGS_STORED_SCHEMA = T.StructType(LOGS_SCHEMA.fields + [T.StructField("month", T.IntegerType(), False)])

APP_LOGS_SCHEMA = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("timestamp", _TS, False),
        T.StructField("level", _S, False),
        T.StructField("category", _S, True),
        T.StructField("message", _S, False),
        T.StructField("exception", _S, True),
        T.StructField("request_method", _S, True),
        T.StructField("request_path", _S, True),
        T.StructField("status_code", T.IntegerType(), True),
        T.StructField("duration_ms", T.DoubleType(), True),
        T.StructField("created_at", _TS, True),
    ]
)

PROJECTS_SCHEMA = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("name", _S, False),
        T.StructField("api_key", _S, False),
        T.StructField("created_at", _TS, False),
        T.StructField("expires_at", _TS, True),
    ]
)

RAW_LOGS_SCHEMA = T.StructType(
    [
        T.StructField("raw_id", T.LongType(), False),
        T.StructField("received_at", _TS, False),
        T.StructField("api_key", _S, True),
        T.StructField("client_ip", _S, True),
        T.StructField("body", _S, True),
    ]
)

# Column lists of the read paths.
LOG_PAGE_COLUMNS = tuple(f.name for f in LOGS_SCHEMA.fields if f.name != "created_at")
TRACE_COLUMNS = ("id", "timestamp", "level", "app_name", "message", "metadata", "exception_type", "source")
APP_LOG_PAGE_COLUMNS = tuple(f.name for f in APP_LOGS_SCHEMA.fields if f.name != "created_at")

# Defaults written for absent text/number fields.
LOG_DEFAULTS = {
    "metadata": "{}",
    "exception_type": "",
    "exception_message": "",
    "exception_stacktrace": "",
    "source": "",
    "request_method": "",
    "request_path": "",
    "status_code": 0,
    "duration_ms": 0.0,
    "user_id": "",
    "trace_id": "",
    "span_id": "",
    "host": "",
    "environment": "production",
    "project_name": "",
}


def add_missing_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Bring ``df`` to ``schema`` — absent columns get their typed default (or null),
    present ones are cast, and the result is in schema order. One projection, no shuffle."""
    defaults = defaults or {}
    present = set(df.columns)
    cols: list[Column] = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            value = defaults.get(field.name)
            cols.append(F.lit(value).cast(field.dataType).alias(field.name))
    return df.select(*cols)
