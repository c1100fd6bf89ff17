"""logsmith — log analytics on Spark DataFrames.

Structured application logs (batch files or a JSON event stream) are validated and
enriched against a project table, stored as month-partitioned Parquet and queried with
DataFrame operators: filtered paging, dashboard statistics, message-pattern mining,
distributed trace timelines, request-log classification and redaction, retention and
exports. Every relative-time operator takes an explicit ``as_of`` so results are
reproducible.
"""

from logsmith.schema import LEVELS, LOGS_SCHEMA, APP_LOGS_SCHEMA, PROJECTS_SCHEMA
from logsmith.operators.filters import LogFilter, AppLogFilter, filter_logs, filter_app_logs

__all__ = [
    "LEVELS",
    "LOGS_SCHEMA",
    "APP_LOGS_SCHEMA",
    "PROJECTS_SCHEMA",
    "LogFilter",
    "AppLogFilter",
    "filter_logs",
    "filter_app_logs",
]
