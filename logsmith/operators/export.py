"""Export formats and display columns: plain log lines (S10), CSV rows (S9), JSON records
(S8), and the per-row display fields E5, E6, E13, E16, E20. Pure projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsmith.functions.display import display_name
from logsmith.functions.json import metadata_display, metadata_field
from logsmith.functions.levels import level_short
from logsmith.functions.text import mask_email
from logsmith.functions.time import relative_age

# CSV export header, in column order.
CSV_HEADER = ("id", "timestamp", "level", "appName", "environment", "host", "message", "source", "userId",
              "exceptionType", "exceptionMessage", "requestMethod", "requestPath", "statusCode", "durationMs",
              "traceId", "metadata")


def _iso_json(col: str = "timestamp") -> Column:
    """Timestamp as the log API serialises it: ISO-8601, fraction without trailing zeros."""
    frac = F.regexp_replace(F.date_format(F.col(col), "SSS"), "0+$", "")
    return F.concat(F.date_format(F.col(col), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def log_lines(df: DataFrame) -> DataFrame:
    """``[yyyy-MM-dd HH:mm:ss.SSS] LVL [app] message | metadata`` (app part empty when
    the app name is empty; metadata part only when metadata is non-empty)."""
    app = F.when(F.coalesce(F.col("app_name"), F.lit("")) != "", F.concat(F.lit("["), F.col("app_name"), F.lit("]")))
    meta = F.when(F.coalesce(F.col("metadata"), F.lit("")) != "", F.concat(F.lit(" | "), F.col("metadata")))
    line = F.concat(
        F.lit("["), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] "),
        level_short("level"), F.lit(" "), F.coalesce(app, F.lit("")), F.lit(" "),
        F.coalesce(F.col("message"), F.lit("")), F.coalesce(meta, F.lit("")),
    )
    return df.select("id", line.alias("line"))


def _quoted(col: str, newline_escape: bool = False) -> Column:
    v = F.replace(F.coalesce(F.col(col), F.lit("")), F.lit('"'), F.lit('""'))
    if newline_escape:
        v = F.replace(v, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), v, F.lit('"'))


def _blank_if_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _number(col: str) -> Column:
    """Numbers as a script prints them: 0 / null -> empty, whole values without '.0', plain
    decimals from 1e-6 on, below that ``1e-7``."""
    c = F.col(col).cast("double")
    plain = F.regexp_replace(c.cast("decimal(38,17)").cast("string"), "\\.?0+$", "")
    tiny = F.replace(F.lower(F.regexp_replace(c.cast("string"), "\\.0E", "E")), F.lit("e+"), F.lit("e"))
    txt = F.when(F.abs(c) < 1e-6, tiny).otherwise(plain)
    return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(txt)


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line per row in the 17-column layout (text fields that may hold commas
    are always quoted; quotes doubled; newlines in the message written as ``\\n``)."""
    fields = [
        F.col("id"), _iso_json("timestamp"), F.col("level"), _quoted("app_name"), _blank_if_empty("environment"),
        _blank_if_empty("host"), _quoted("message", newline_escape=True), _blank_if_empty("source"),
        _blank_if_empty("user_id"), _blank_if_empty("exception_type"), _quoted("exception_message"),
        _blank_if_empty("request_method"), _blank_if_empty("request_path"), _number("status_code"),
        _number("duration_ms"), _blank_if_empty("trace_id"), _quoted("metadata"),
    ]
    return df.select("id", F.concat_ws(",", *fields).alias("line"))


def csv_header_line() -> str:
    return ",".join(CSV_HEADER)


def json_records(df: DataFrame) -> DataFrame:
    """camelCase JSON object per row (written with ``df.write.json``)."""
    names = dict(zip(
        ("id", "timestamp", "level", "app_name", "message", "metadata", "exception_type", "exception_message",
         "source", "request_method", "request_path", "status_code", "duration_ms", "user_id", "trace_id", "span_id",
         "host", "environment", "project_id", "project_name"),
        ("id", "timestamp", "level", "appName", "message", "metadata", "exceptionType", "exceptionMessage",
         "source", "requestMethod", "requestPath", "statusCode", "durationMs", "userId", "traceId", "spanId",
         "host", "environment", "projectId", "projectName"),
    ))
    return df.select(*[F.col(k).alias(v) for k, v in names.items() if k in df.columns])


def log_display(df: DataFrame, as_of, email_col: Column | None = None) -> DataFrame:
    """Display fields: name (E20), age (E16), normalised metadata (E5), one metadata key
    (E6) and a masked e-mail (E13)."""
    email = email_col if email_col is not None else F.concat(F.col("user_id"), F.lit("@"), F.col("host"))
    return df.select(
        "id",
        display_name().alias("display_name"),
        relative_age("timestamp", as_of).alias("age"),
        metadata_display("metadata").alias("metadata_json"),
        metadata_field("k", "metadata").alias("metadata_k"),
        mask_email(email).alias("masked_email"),
    )
