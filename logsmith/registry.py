"""Registered queries over the fixture views, with their DuckDB oracle SQL.

Each Spark query reads the driver's tables (through the views of ``sources.fixtures``) in
full; each oracle runs the same view text as CTEs in DuckDB. Column names are aliased the
same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsmith.functions.time import fmt_ts, preset_range
from logsmith.operators import enrich, export, patterns, retention, rollup, search, stats, traces
from logsmith.operators.batch_ingest import run_batch_ingest
from logsmith.operators import projects as proj
from logsmith.operators import requests as reqs
from logsmith.operators.filters import AppLogFilter, LogFilter
from logsmith.schema import APP_LOG_PAGE_COLUMNS, LEVELS, LOG_PAGE_COLUMNS, LOGS_SCHEMA, TRACE_COLUMNS
from logsmith.session import scratch_path
from logsmith.sources import fixtures as fx
from logsmith.sources import sinks
from logsmith.sources.file_index import MESSAGE_INDEX, TRACE_INDEX, grams
from logsmith.sources.manifest import ManifestTable, logs_table, rejections_table
from logsmith.sources.fixtures import AS_OF
from logsmith.streaming import ingest as s_ingest
from logsmith.streaming import rate as s_rate
from logsmith.streaming import tail as s_tail

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def _cols(names) -> str:
    return ", ".join(names)


_AS_OF_TS = f"TIMESTAMP '{AS_OF}'"
H24_SQL = "TIMESTAMP '2024-01-30 00:00:00'"  # as_of - 24 h
H1_SQL = "TIMESTAMP '2024-01-30 23:00:00'"  # as_of - 1 h

# ---------------------------------------------------------------- stats


@register(
    "top_apps",
    fx.duck_with("logs")
    + f"""SELECT app_name, count(*) AS log_count, count(*) FILTER (WHERE level = 'Error') AS error_count
FROM logs WHERE timestamp > {H24_SQL}
GROUP BY app_name ORDER BY log_count DESC, app_name LIMIT 10""",
)
def q_top_apps(spark, sf_dir):
    return stats.top_apps(fx.logs(spark, sf_dir), AS_OF)


@register(
    "log_stats",
    fx.duck_with("logs")
    + f"""SELECT count(*) AS total_logs,
 count(*) FILTER (WHERE level = 'Error') AS error_count,
 count(*) FILTER (WHERE level = 'Warning') AS warning_count,
 CAST(count(*) FILTER (WHERE timestamp > {H1_SQL}) AS DOUBLE) / 60.0 AS logs_per_minute
FROM logs WHERE timestamp > {H24_SQL}""",
)
def q_log_stats(spark, sf_dir):
    return stats.log_stats(fx.logs(spark, sf_dir), AS_OF)


@register("distinct_apps", fx.duck_with("logs") + "SELECT DISTINCT app_name FROM logs ORDER BY app_name")
def q_distinct_apps(spark, sf_dir):
    return stats.distinct_apps(fx.logs(spark, sf_dir))


@register(
    "distinct_environments",
    fx.duck_with("logs") + "SELECT DISTINCT environment FROM logs WHERE environment <> '' ORDER BY environment",
)
def q_distinct_environments(spark, sf_dir):
    return stats.distinct_environments(fx.logs(spark, sf_dir))


# ---------------------------------------------------------------- search (F*, K3, K4, A1, A11)

PAGE_FILTER = LogFilter(levels="Info, Warning", search="order", status_min=200, status_max=404)


@register(
    "log_page_filtered",
    fx.duck_with("logs")
    + f"""SELECT {_cols(LOG_PAGE_COLUMNS)} FROM logs
WHERE level IN ('Info', 'Warning') AND contains(lower(message), 'order') AND status_code >= 200 AND status_code <= 404
ORDER BY timestamp DESC, id LIMIT 50 OFFSET 50""",
)
def q_log_page_filtered(spark, sf_dir):
    return search.log_page(fx.logs(spark, sf_dir), PAGE_FILTER, page=2, page_size=50)


COUNT_FILTER = LogFilter(app_name="svc-3", environment="production", request_method="GET", status_min=100,
                         time_from="2024-01-05 00:00:00", time_to="2024-01-20 12:30:45.678")


@register(
    "log_count_filtered",
    fx.duck_with("logs")
    + """SELECT count(*) AS total_count, 25 AS page_size, CAST(ceil(count(*) / 25.0) AS INTEGER) AS total_pages
FROM logs WHERE app_name = 'svc-3' AND environment = 'production' AND request_method = 'GET' AND status_code >= 100
 AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 12:30:45'""",
)
def q_log_count_filtered(spark, sf_dir):
    return search.log_count(fx.logs(spark, sf_dir), COUNT_FILTER, page_size=25)


EXC_FILTER = LogFilter(exception_type="ConnectionException", source="Handler2", project_id="p7", user_id=None)


@register(
    "log_count_exceptions",
    fx.duck_with("logs")
    + """SELECT count(*) AS total_count, 50 AS page_size, CAST(ceil(count(*) / 50.0) AS INTEGER) AS total_pages
FROM logs WHERE exception_type = 'ConnectionException' AND source = 'Handler2' AND project_id = 'p7'""",
)
def q_log_count_exceptions(spark, sf_dir):
    return search.log_count(fx.logs(spark, sf_dir), EXC_FILTER)


USER_FILTER = LogFilter(user_id="user_7", status_max=200, levels=["debug", "INFO"])


@register(
    "log_page_user",
    fx.duck_with("logs")
    + f"""SELECT {_cols(LOG_PAGE_COLUMNS)} FROM logs
WHERE user_id = 'user_7' AND status_code <= 200 AND level IN ('Debug', 'Info')
ORDER BY timestamp DESC, id LIMIT 500""",
)
def q_log_page_user(spark, sf_dir):
    return search.log_page(fx.logs(spark, sf_dir), USER_FILTER, page=0, page_size=999)


@register(
    "log_search_literal",
    fx.duck_with("logs")
    + """SELECT id, timestamp, message FROM logs WHERE contains(lower(message), '100%_ok')""",
)
def q_log_search_literal(spark, sf_dir):
    return search.filter_logs(fx.logs(spark, sf_dir), LogFilter(search="100%_OK")).select("id", "timestamp", "message")


@register(
    "log_time_range",
    fx.duck_with("logs")
    + """SELECT id, timestamp, level, app_name FROM logs
WHERE timestamp >= TIMESTAMP '2024-01-10 10:15:30' AND timestamp <= TIMESTAMP '2024-01-12 08:00:59'""",
)
def q_log_time_range(spark, sf_dir):
    f = LogFilter(time_from="2024-01-10T13:15:30.750+03:00", time_to="2024-01-12T03:00:59.999-05:00")
    return search.filter_logs(fx.logs(spark, sf_dir), f).select("id", "timestamp", "level", "app_name")


_P_FROM, _P_TO = preset_range("2024-01-30 23:59:41.5", 6)


@register(
    "log_preset_range",
    fx.duck_with("logs")
    + f"""SELECT id, timestamp, level, app_name FROM logs
WHERE timestamp >= TIMESTAMP '{fmt_ts(_P_FROM)}' AND timestamp <= TIMESTAMP '{fmt_ts(_P_TO)}'""",
)
def q_log_preset_range(spark, sf_dir):
    f = LogFilter(time_from=_P_FROM, time_to=_P_TO)
    return search.filter_logs(fx.logs(spark, sf_dir), f).select("id", "timestamp", "level", "app_name")


@register(
    "log_level_intersection",
    fx.duck_with("logs")
    + """SELECT id, timestamp, level, app_name, message FROM logs
WHERE level = 'Error' AND level IN ('Error', 'Fatal') AND app_name = 'svc-5'""",
)
def q_log_level_intersection(spark, sf_dir):
    f = LogFilter(level="error", levels="Error,Fatal", app_name="svc-5")
    return search.filter_logs(fx.logs(spark, sf_dir), f).select("id", "timestamp", "level", "app_name", "message")


# ---------------------------------------------------------------- patterns

_PATTERN_SELECT = """SELECT regexp_replace(substring(message, 1, 100), '[0-9]+', '*', 'g') AS pattern, count(*) AS cnt,
 level, app_name, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
 min(struct_pack(t := timestamp, m := message)).m AS sample_message
FROM logs WHERE timestamp > TIMESTAMP '{start}' {extra}
GROUP BY pattern, level, app_name HAVING count(*) >= {min_count}
ORDER BY cnt DESC, pattern, level, app_name LIMIT {limit}"""


@register(
    "log_patterns",
    fx.duck_with("logs") + _PATTERN_SELECT.format(start="2024-01-01 00:00:00", extra="", min_count=2, limit=50),
)
def q_log_patterns(spark, sf_dir):
    return patterns.log_patterns(fx.logs(spark, sf_dir), AS_OF, hours=720, min_count=2, limit=50)


@register(
    "log_patterns_errors",
    fx.duck_with("logs")
    + _PATTERN_SELECT.format(start="2024-01-24 00:00:00", extra="AND level IN ('Error', 'Fatal')", min_count=3,
                             limit=1000),
)
def q_log_patterns_errors(spark, sf_dir):
    return patterns.log_patterns(fx.logs(spark, sf_dir), AS_OF, hours=168, levels="error, FATAL, bogus",
                                 min_count=3, limit=1000)


# ---------------------------------------------------------------- traces

_TRACE_CTE = f""", ranked AS (
 SELECT trace_id, {_cols(TRACE_COLUMNS)},
  CAST(row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, id) AS INTEGER) AS entry_no
 FROM logs WHERE trace_id <> '' {{extra}}),
capped AS (SELECT *, max(entry_no) OVER (PARTITION BY trace_id) > 500 AS truncated FROM ranked QUALIFY entry_no <= 500)
"""


@register(
    "trace_timeline",
    fx.duck_with("logs")
    + _TRACE_CTE.format(extra="")
    + f"""SELECT trace_id, {_cols(TRACE_COLUMNS)}, entry_no,
 CAST(date_diff('microsecond', min(timestamp) OVER (PARTITION BY trace_id), timestamp) AS DOUBLE) / 1000.0 AS offset_ms,
 truncated
FROM capped""",
)
def q_trace_timeline(spark, sf_dir):
    return traces.trace_timelines(fx.logs(spark, sf_dir))


LOOKUP_TRACE = "trace-48"


@register(
    "trace_lookup",
    fx.duck_with("logs")
    + _TRACE_CTE.format(extra=f"AND trace_id = '{LOOKUP_TRACE}'")
    + f"""SELECT trace_id, {_cols(TRACE_COLUMNS)}, entry_no,
 CAST(date_diff('microsecond', min(timestamp) OVER (PARTITION BY trace_id), timestamp) AS DOUBLE) / 1000.0 AS offset_ms,
 truncated
FROM capped""",
)
def q_trace_lookup(spark, sf_dir):
    return traces.trace_timeline(fx.logs(spark, sf_dir), LOOKUP_TRACE)


@register(
    "trace_summary",
    fx.duck_with("logs")
    + _TRACE_CTE.format(extra="")
    + """, firsts AS (SELECT trace_id, app_name, min(entry_no) AS first_no FROM ranked GROUP BY trace_id, app_name),
svc AS (SELECT trace_id, string_agg(app_name, ',' ORDER BY first_no) AS services, CAST(count(*) AS INTEGER) AS service_count
        FROM firsts GROUP BY trace_id)
SELECT c.trace_id, CAST(count(*) AS BIGINT) AS entry_count, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
 CAST(date_diff('microsecond', min(timestamp), max(timestamp)) AS DOUBLE) / 1000.0 AS total_duration_ms,
 any_value(s.services) AS services, any_value(s.service_count) AS service_count,
 bool_or(level IN ('Error', 'Fatal')) AS has_errors
FROM ranked c JOIN svc s ON c.trace_id = s.trace_id
GROUP BY c.trace_id""",
)
def q_trace_summary(spark, sf_dir):
    return traces.trace_summaries(fx.logs(spark, sf_dir))


# ---------------------------------------------------------------- ingest


def _duck_level(expr: str) -> str:
    parts = " ".join(
        f"WHEN lower(trim({expr})) = '{name.lower()}' OR (regexp_full_match(trim({expr}), '[+-]?[0-9]+')"
        f" AND TRY_CAST(trim({expr}) AS INTEGER) = {code}) THEN '{name}'" for name, code in LEVELS
    )
    return f"CASE {parts} ELSE 'Info' END"


def _duck_entry(rec: str, id_expr: str) -> str:
    """Stored-entry columns of a parsed JSON record in DuckDB."""
    s = lambda f: f"json_extract_string({rec}, '$.{f}')"
    e = lambda f: f"coalesce({s(f)}, '')"
    return f"""{id_expr} AS id, received_at AS timestamp,
 {_duck_level(s('level'))} AS level,
 {e('appName')} AS app_name, {e('message')} AS message,
 coalesce(CAST(json_extract({rec}, '$.metadata') AS VARCHAR), '{{}}') AS metadata,
 {e('exceptionType')} AS exception_type, {e('exceptionMessage')} AS exception_message,
 {e('exceptionStacktrace')} AS exception_stacktrace, {e('source')} AS source,
 {e('requestMethod')} AS request_method, {e('requestPath')} AS request_path,
 coalesce(CAST(json_extract({rec}, '$.statusCode') AS INTEGER), 0) AS status_code,
 coalesce(CAST(json_extract({rec}, '$.durationMs') AS DOUBLE), 0.0) AS duration_ms,
 {e('userId')} AS user_id, {e('traceId')} AS trace_id, {e('spanId')} AS span_id,
 coalesce(nullif({s('host')}, ''), client_ip, '') AS host,
 coalesce({s('environment')}, 'production') AS environment,
 p.id AS project_id, p.name AS project_name, received_at AS created_at"""


_DUCK_DEDUP = """, dedup AS (
 SELECT id, name, api_key, created_at, expires_at FROM (
  SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY created_at DESC, id DESC) AS rn FROM {src}) WHERE rn = 1)
"""
_DUCK_OBJECT = "(body IS NOT NULL AND json_valid(body) AND ltrim(body) LIKE '{%')"
_DUCK_OK = f", ok AS (SELECT * FROM raw_logs WHERE {_DUCK_OBJECT})\n"
_DUCK_VALID = "p.id IS NOT NULL AND (p.expires_at IS NULL OR p.expires_at >= r.received_at)"


_DUCK_REASON = """SELECT r.raw_id, r.api_key, r.received_at,
 CASE WHEN r.api_key IS NULL OR r.api_key = '' THEN 'missing_key' WHEN p.id IS NULL THEN 'unknown_key'
      WHEN p.expires_at < r.received_at THEN 'expired_key' WHEN NOT {ok} THEN 'malformed' END AS reason
FROM {src} r LEFT JOIN dedup p ON r.api_key = p.api_key
WHERE reason IS NOT NULL"""


@register(
    "ingest_accepted",
    fx.duck_with("raw_logs", "projects")
    + _DUCK_DEDUP.format(src="projects")
    + _DUCK_OK
    + f"""SELECT {_duck_entry('r.body', 'CAST(r.raw_id AS VARCHAR)')}
FROM ok r LEFT JOIN dedup p ON r.api_key = p.api_key
WHERE {_DUCK_VALID}""",
)
def q_ingest_accepted(spark, sf_dir):
    classified = enrich.ingest_records(fx.raw_logs(spark, sf_dir), fx.projects(spark, sf_dir))
    return enrich.to_logs(classified)


@register(
    "ingest_rejected",
    fx.duck_with("raw_logs", "projects")
    + _DUCK_DEDUP.format(src="projects")
    + _DUCK_REASON.format(src="raw_logs", ok=_DUCK_OBJECT),
)
def q_ingest_rejected(spark, sf_dir):
    classified = enrich.ingest_records(fx.raw_logs(spark, sf_dir), fx.projects(spark, sf_dir))
    return enrich.rejected(classified)


@register(
    "ingest_batch",
    fx.duck_with("raw_batches", "projects")
    + _DUCK_DEDUP.format(src="projects")
    + """, items AS (
 SELECT raw_id, received_at, api_key, client_ip,
  unnest(json_extract(body, '$.logs[*]')) AS rec, unnest(range(CAST(json_array_length(body, '$.logs') AS BIGINT))) AS pos
 FROM raw_batches WHERE body NOT LIKE '%,null]}')
"""
    + f"""SELECT {_duck_entry('r.rec', "CAST(r.raw_id AS VARCHAR) || '-' || CAST(r.pos AS VARCHAR)")}
FROM items r LEFT JOIN dedup p ON r.api_key = p.api_key
WHERE {_DUCK_VALID}""",
)
def q_ingest_batch(spark, sf_dir):
    classified = enrich.ingest_batches(fx.raw_batches(spark, sf_dir), fx.projects(spark, sf_dir))
    return enrich.to_logs(classified, id_col="entry_id")


@register(
    "ingest_batch_rejected",
    fx.duck_with("raw_batches", "projects")
    + _DUCK_DEDUP.format(src="projects")
    + _DUCK_REASON.format(src="raw_batches", ok="(r.body NOT LIKE '%,null]}')"),
)
def q_ingest_batch_rejected(spark, sf_dir):
    """J2 on batches: a row per rejected envelope (bad key, also of an empty one; null element)."""
    return enrich.rejected(enrich.ingest_batches(fx.raw_batches(spark, sf_dir), fx.projects(spark, sf_dir)))


@register(
    "api_key_dedupe",
    fx.duck_with("project_history")
    + _DUCK_DEDUP.format(src="project_history")
    + "SELECT * FROM dedup",
)
def q_api_key_dedupe(spark, sf_dir):
    return enrich.dedupe_keys(fx.project_history(spark, sf_dir))


# ---------------------------------------------------------------- request log


_DUCK_REQUEST_LOG = """, redacted AS (
 SELECT *, CASE WHEN instr(request_path, '?') > 0
   THEN substr(request_path, 1, instr(request_path, '?') - 1)
        || regexp_replace(substr(request_path, instr(request_path, '?')), '(apiKey|token|key|secret)=[^&]*', '\\1=***', 'gi')
   ELSE request_path END AS p
 FROM requests),
request_log AS (
 SELECT id, timestamp,
  CASE WHEN exception IS NOT NULL OR status_code >= 500 THEN 'Error' WHEN status_code >= 400 THEN 'Warning' ELSE 'Information' END AS level,
  'HTTP' AS category,
  concat(request_method, ' ', p, ' -> ', CAST(status_code AS VARCHAR), ' (', CAST(CAST(floor(duration_ms) AS BIGINT) AS VARCHAR), 'ms)') AS message,
  CASE WHEN len(string_split(exception, chr(10))) > 5
       THEN array_to_string(string_split(exception, chr(10))[1:5], chr(10)) || chr(10) || '... (truncated)'
       ELSE exception END AS exception,
  request_method, p AS request_path, status_code, round(duration_ms, 2) AS duration_ms, timestamp AS created_at
 FROM redacted WHERE NOT coalesce(regexp_matches(p, '^/(css|js|lib|images|favicon)'), false))
"""


@register("request_log", fx.duck_with("requests") + _DUCK_REQUEST_LOG + "SELECT * FROM request_log")
def q_request_log(spark, sf_dir):
    return reqs.request_log(fx.requests(spark, sf_dir))


@register(
    "request_status_summary",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG
    + """SELECT level, CASE WHEN status_code >= 500 THEN '5xx' WHEN status_code >= 400 THEN '4xx'
   WHEN status_code >= 200 AND status_code < 300 THEN '2xx' ELSE 'other' END AS status_class,
 count(*) AS requests,
 CAST(sum(CAST(round(duration_ms * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS avg_duration_ms
FROM request_log GROUP BY 1, 2""",
)
def q_request_status_summary(spark, sf_dir):
    return reqs.status_summary(reqs.request_log(fx.requests(spark, sf_dir)))


APP_FILTER = AppLogFilter(levels="Warning,Error", search="POST", time_from="2024-01-03 00:00:00",
                          time_to="2024-01-25 18:00:00")


@register(
    "app_log_page",
    fx.duck_with("app_logs")
    + f"""SELECT {_cols(APP_LOG_PAGE_COLUMNS)} FROM app_logs
WHERE level IN ('Warning', 'Error') AND contains(lower(message), 'post')
 AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp <= TIMESTAMP '2024-01-25 18:00:00'
ORDER BY timestamp DESC, id LIMIT 100 OFFSET 100""",
)
def q_app_log_page(spark, sf_dir):
    return search.app_log_page(fx.app_logs(spark, sf_dir), APP_FILTER, page=2, page_size=100)


@register(
    "app_log_count",
    fx.duck_with("app_logs")
    + """SELECT count(*) AS total_count, 100 AS page_size, CAST(ceil(count(*) / 100.0) AS INTEGER) AS total_pages
FROM app_logs WHERE level IN ('Warning', 'Error') AND contains(lower(message), 'post')
 AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp <= TIMESTAMP '2024-01-25 18:00:00'""",
)
def q_app_log_count(spark, sf_dir):
    return search.app_log_count(fx.app_logs(spark, sf_dir), APP_FILTER, page_size=100)


@register(
    "rate_audit",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG
    + """, b AS (SELECT time_bucket(INTERVAL '15 minutes', timestamp, TIMESTAMP '1970-01-01') AS window_start, timestamp, id
  FROM request_log),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY timestamp, id) AS rn FROM b)
SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, count(*) AS requests,
 least(count(*), 5) AS permitted, greatest(count(*) - 5, 0) AS rejected,
 max(timestamp) FILTER (WHERE rn = 6) AS first_rejected_at
FROM r GROUP BY window_start""",
)
def q_rate_audit(spark, sf_dir):
    return reqs.rate_audit(reqs.request_log(fx.requests(spark, sf_dir)), policy="login")


# ---------------------------------------------------------------- projects


@register(
    "project_status",
    fx.duck_with("projects")
    + f"""SELECT id, name,
 CASE WHEN length(api_key) > 12 THEN substr(api_key, 1, 8) || '...' || right(api_key, 4) ELSE api_key END AS masked_key,
 created_at, expires_at,
 CASE WHEN expires_at < {_AS_OF_TS} THEN 'Expired' ELSE 'Active' END AS status,
 CAST(trunc(date_diff('microsecond', {_AS_OF_TS}, expires_at) / 86400000000.0) AS INTEGER) AS days_left,
 coalesce(expires_at >= {_AS_OF_TS} AND date_diff('microsecond', {_AS_OF_TS}, expires_at) < 604800000000, false) AS expiry_warning,
 CASE WHEN expires_at IS NULL THEN 'Never'
      WHEN expires_at < {_AS_OF_TS} THEN 'Expired ' || strftime(expires_at, '%Y-%m-%d')
      ELSE strftime(expires_at, '%Y-%m-%d') || ' (' || CAST(CAST(trunc(date_diff('microsecond', {_AS_OF_TS}, expires_at) / 86400000000.0) AS INTEGER) AS VARCHAR) || 'd left)' END AS expiry_label
FROM projects ORDER BY created_at, id""",
)
def q_project_status(spark, sf_dir):
    return proj.project_status(fx.projects(spark, sf_dir), AS_OF)


@register(
    "project_rename",
    fx.duck_with("projects")
    + "SELECT id, CASE WHEN id = 'p3' THEN 'CANADA (renamed)' ELSE name END AS name, api_key, created_at, expires_at FROM projects",
)
def q_project_rename(spark, sf_dir):
    return proj.rename_project(fx.projects(spark, sf_dir), "p3", "CANADA (renamed)")


@register("project_delete", fx.duck_with("projects") + "SELECT * FROM projects WHERE id <> 'p5'")
def q_project_delete(spark, sf_dir):
    return proj.delete_project(fx.projects(spark, sf_dir), "p5")


@register(
    "project_insert",
    fx.duck_with("projects")
    + f"""SELECT * FROM projects UNION ALL
SELECT 'p-new', 'NEW PROJECT', 'demo_key_new_0123456789', {_AS_OF_TS}, {_AS_OF_TS} + INTERVAL 30 DAY""",
)
def q_project_insert(spark, sf_dir):
    return proj.insert_project(spark, fx.projects(spark, sf_dir), "p-new", "NEW PROJECT", "demo_key_new_0123456789",
                               AS_OF, expiry_days=30)


# ---------------------------------------------------------------- retention (M1, M3)


@register(
    "retention_delete",
    fx.duck_with("logs")
    + "SELECT id, timestamp, level, app_name FROM logs WHERE timestamp >= TIMESTAMP '2024-01-21 00:00:00'",
)
def q_retention_delete(spark, sf_dir):
    return retention.delete_older_than(fx.logs(spark, sf_dir), AS_OF, 10).select("id", "timestamp", "level", "app_name")


@register(
    "retention_ttl",
    fx.duck_with("logs")
    + "SELECT id, created_at, level, app_name FROM logs WHERE created_at > TIMESTAMP '2024-01-24 00:00:00'",
)
def q_retention_ttl(spark, sf_dir):
    return retention.ttl_expire(fx.logs(spark, sf_dir), AS_OF, 7).select("id", "created_at", "level", "app_name")


# ---------------------------------------------------------------- selection, exports, display (J3, S8-S10, E5 ...)


def _selected(spark, sf_dir):
    """The log rows that a list of ids names (the keys of urgent orders)."""
    ids = fx.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("id"))
    return enrich.select_by_ids(fx.logs(spark, sf_dir), ids)


_DUCK_SELECTED = """, selected AS (SELECT * FROM logs WHERE id IN (
  SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'))
"""


@register(
    "error_trace_logs",
    fx.duck_with("logs")
    + """SELECT id, timestamp, level, app_name, trace_id FROM logs WHERE trace_id IN (
  SELECT trace_id FROM logs WHERE level IN ('Error', 'Fatal') AND trace_id <> '')""",
)
def q_error_trace_logs(spark, sf_dir):
    """Every row of a trace that has an Error or Fatal entry; rows without a trace are dropped
    before the join, on both sides."""
    rows = fx.logs(spark, sf_dir).where(F.col("trace_id") != "")
    bad = rows.where(F.col("level").isin("Error", "Fatal")).select("trace_id").distinct()
    return rows.join(bad, "trace_id", "left_semi").select("id", "timestamp", "level", "app_name", "trace_id")


@register(
    "selected_logs",
    fx.duck_with("logs") + _DUCK_SELECTED + "SELECT id, timestamp, level, app_name, trace_id FROM selected",
)
def q_selected_logs(spark, sf_dir):
    return _selected(spark, sf_dir).select("id", "timestamp", "level", "app_name", "trace_id")


def _duck_short_level() -> str:
    from logsmith.functions.levels import LEVEL_SHORT

    whens = " ".join(f"WHEN '{n}' THEN '{s}'" for (n, _), s in zip(LEVELS, LEVEL_SHORT))
    return f"CASE level {whens} ELSE 'INF' END"


@register(
    "export_lines",
    fx.duck_with("logs") + _DUCK_SELECTED
    + f"""SELECT id, '[' || strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g') || '] ' || {_duck_short_level()} || ' '
 || CASE WHEN coalesce(app_name, '') <> '' THEN '[' || app_name || ']' ELSE '' END || ' ' || coalesce(message, '')
 || CASE WHEN coalesce(metadata, '') <> '' THEN ' | ' || metadata ELSE '' END AS line
FROM selected""",
)
def q_export_lines(spark, sf_dir):
    return export.log_lines(_selected(spark, sf_dir))


def _duck_q(c: str, nl: bool = False) -> str:
    v = f"replace(coalesce({c}, ''), '\"', '\"\"')"
    if nl:
        v = f"replace({v}, chr(10), '\\n')"
    return f"'\"' || {v} || '\"'"


def _duck_num(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR {c} = 0 THEN '' WHEN {c} = floor({c}) THEN CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR)"
            f" ELSE CAST({c} AS VARCHAR) END")


@register(
    "export_csv_rows",
    fx.duck_with("logs") + _DUCK_SELECTED
    + f"""SELECT id, concat_ws(',', id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
   || CASE WHEN rtrim(strftime(timestamp, '%g'), '0') <> '' THEN '.' || rtrim(strftime(timestamp, '%g'), '0') ELSE '' END,
 level, {_duck_q('app_name')},
 coalesce(environment, ''), coalesce(host, ''), {_duck_q('message', True)}, coalesce(source, ''), coalesce(user_id, ''),
 coalesce(exception_type, ''), {_duck_q('exception_message')}, coalesce(request_method, ''), coalesce(request_path, ''),
 {_duck_num('status_code')}, {_duck_num('duration_ms')}, coalesce(trace_id, ''), {_duck_q('metadata')}) AS line
FROM selected""",
)
def q_export_csv_rows(spark, sf_dir):
    return export.csv_lines(_selected(spark, sf_dir))


@register(
    "export_json_records",
    fx.duck_with("logs") + _DUCK_SELECTED
    + """SELECT id, timestamp, level, app_name AS appName, message, metadata, exception_type AS exceptionType,
 exception_message AS exceptionMessage, source, request_method AS requestMethod, request_path AS requestPath,
 status_code AS statusCode, duration_ms AS durationMs, user_id AS userId, trace_id AS traceId, span_id AS spanId,
 host, environment, project_id AS projectId, project_name AS projectName
FROM selected""",
)
def q_export_json_records(spark, sf_dir):
    return export.json_records(_selected(spark, sf_dir))


@register(
    "log_display",
    fx.duck_with("logs")
    + f"""SELECT id, coalesce(nullif(project_name, ''), app_name) AS display_name,
 CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
      WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age,
 CASE WHEN json_valid(metadata) THEN CAST(json(metadata) AS VARCHAR) ELSE metadata END AS metadata_json,
 json_extract_string(metadata, '$.k') AS metadata_k,
 CASE WHEN instr(e, '@') <= 2 THEN '***@***' ELSE substr(e, 1, 1) || '***@' || substr(e, instr(e, '@') + 1) END AS masked_email
FROM (SELECT *, date_sub('second', timestamp, {_AS_OF_TS}) AS s, user_id || '@' || host AS e FROM logs)""",
)
def q_log_display(spark, sf_dir):
    return export.log_display(fx.logs(spark, sf_dir), AS_OF)


# ---------------------------------------------------------------- streaming
# Each streaming key writes its derived input (in several files) under the session's
# checkpoint folder, drains it with an availableNow trigger and reads the sink back.
# Processing-time stamps are dropped from the result (they differ per run).


# A micro-batch takes about this much, and one file at least; more of a large backlog.
STREAM_TRIGGER = 256 * 1024


def _stage_input(df: DataFrame, path: str, dealt: bool = True) -> None:
    """Write the derived input: as many files as shuffle partitions, each a random share of the
    rows, so micro-batches are out of order. ``dealt``: the view's events are shared out already."""
    (df if dealt else fx.shares(df)).write.parquet(path)


def _stream(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", s_ingest.drain_trigger(spark, path, STREAM_TRIGGER)).parquet(path)


def _await(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


_INGEST_COLS = [f.name for f in LOGS_SCHEMA.fields if f.name not in ("timestamp", "created_at")]


@register(
    "stream_ingest",
    fx.duck_with("raw_logs", "projects")
    + _DUCK_DEDUP.format(src="projects")
    + _DUCK_OK
    + f"""SELECT {_cols(_INGEST_COLS)} FROM (SELECT {_duck_entry('r.body', 'CAST(r.raw_id AS VARCHAR)')}
FROM ok r LEFT JOIN dedup p ON r.api_key = p.api_key
WHERE {_DUCK_VALID})""",
)
def q_stream_ingest(spark, sf_dir):
    base = scratch_path(spark, "stream-ingest")
    _stage_input(fx.raw_logs(spark, sf_dir, spread=True), f"{base}/raw")
    q = s_ingest.start_log_ingest(
        spark, f"{base}/raw", lambda: fx.projects(spark, sf_dir), f"{base}/logs", f"{base}/rejected",
        f"{base}/_checkpoint", available_now=True, max_bytes_per_trigger=s_ingest.drain_trigger(spark, f"{base}/raw", STREAM_TRIGGER),
    )
    _await(q)
    return spark.read.parquet(f"{base}/logs").select(*_INGEST_COLS)


_APP_COLS_NO_STAMP = [c for c in ("id", "timestamp", "level", "category", "message", "exception", "request_method",
                                  "request_path", "status_code", "duration_ms")]


@register(
    "stream_app_logs",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG + f"SELECT {_cols(_APP_COLS_NO_STAMP)} FROM request_log",
)
def q_stream_app_logs(spark, sf_dir):
    base = scratch_path(spark, "stream-app-logs")
    src = fx.requests(spark, sf_dir, spread=True)
    _stage_input(src, f"{base}/requests")
    stream = _stream(spark, src.schema, f"{base}/requests")
    _await(s_ingest.start_request_ingest(spark, stream, f"{base}/app_logs", f"{base}/_checkpoint",
                                         available_now=True))
    return spark.read.parquet(f"{base}/app_logs").select(*_APP_COLS_NO_STAMP)


TAIL_FILTER = LogFilter(levels="Warning,Error,Fatal", app_name="svc-3")


@register(
    "stream_tail",
    fx.duck_with("logs")
    + f"""SELECT {_cols(LOG_PAGE_COLUMNS)} FROM logs WHERE level IN ('Warning', 'Error', 'Fatal') AND app_name = 'svc-3'
ORDER BY timestamp DESC, id LIMIT 100""",
)
def q_stream_tail(spark, sf_dir):
    base = scratch_path(spark, "stream-tail")
    _stage_input(fx.logs(spark, sf_dir, spread=True), f"{base}/logs")
    stream = _stream(spark, LOGS_SCHEMA, f"{base}/logs")
    _await(s_tail.start_tail(spark, stream, TAIL_FILTER, f"{base}/tail", f"{base}/_checkpoint", available_now=True))
    return s_tail.newest(s_tail.read_tail(spark, f"{base}/tail", LOGS_SCHEMA).select(*LOG_PAGE_COLUMNS), 100)


@register(
    "stream_rate_audit",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG
    + """, b AS (SELECT time_bucket(INTERVAL '15 minutes', timestamp, TIMESTAMP '1970-01-01') AS window_start FROM request_log)
SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, count(*) AS requests,
 least(count(*), 5) AS permitted, greatest(count(*) - 5, 0) AS rejected
FROM b GROUP BY window_start""",
)
def q_stream_rate_audit(spark, sf_dir):
    base = scratch_path(spark, "stream-rate")
    src = reqs.request_log(fx.requests(spark, sf_dir, spread=True))
    _stage_input(src, f"{base}/app_logs")
    _await(s_rate.start_rate_audit(spark, _stream(spark, src.schema, f"{base}/app_logs"), f"{base}/counts",
                                   f"{base}/_checkpoint", available_now=True))
    return s_rate.counts(spark.read.parquet(f"{base}/counts"))


# ---------------------------------------------------------------- stored layout (S1, S2, S6, S7, S12, M1 on storage)
# These keys write the derived table in the stored layout under the session's checkpoint
# folder (a new path per run) and query it back through the declared-schema scans, so
# month pruning and pushed filters are exercised.


STORED_FILTER = LogFilter(levels="Error,Fatal", app_name="svc-3", time_from="2024-01-20 00:00:00",
                          time_to="2024-01-25 23:59:59")


@register(
    "stored_log_search",
    fx.duck_with("logs")
    + f"""SELECT {_cols(LOG_PAGE_COLUMNS)} FROM logs
WHERE level IN ('Error', 'Fatal') AND app_name = 'svc-3'
 AND timestamp >= TIMESTAMP '2024-01-20 00:00:00' AND timestamp <= TIMESTAMP '2024-01-25 23:59:59'
ORDER BY timestamp DESC, id LIMIT 200""",
)
def q_stored_log_search(spark, sf_dir):
    path = scratch_path(spark, "stored-logs")
    sinks.write_logs(fx.logs(spark, sf_dir), path, rewrite=True)
    return search.log_page(sinks.read_logs(spark, path), STORED_FILTER, page=1, page_size=200)


@register(
    "stored_app_log_page",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG
    + f"""SELECT {_cols(APP_LOG_PAGE_COLUMNS)} FROM request_log WHERE level = 'Error'
ORDER BY timestamp DESC, id LIMIT 50 OFFSET 150""",
)
def q_stored_app_log_page(spark, sf_dir):
    path = scratch_path(spark, "stored-app-logs")
    sinks.write_app_logs(reqs.request_log(fx.requests(spark, sf_dir)), path)
    return search.app_log_page(sinks.read_app_logs(spark, path), AppLogFilter(level="Error"), page=4, page_size=50)


@register(
    "retention_rewrite",
    fx.duck_with("logs")
    + "SELECT id, timestamp, level, app_name FROM logs WHERE timestamp >= TIMESTAMP '2024-01-21 00:00:00'",
)
def q_retention_rewrite(spark, sf_dir):
    path = scratch_path(spark, "retention")
    sinks.write_logs(fx.logs(spark, sf_dir), path, rewrite=True)
    retention.apply_retention(spark, path, AS_OF, 10, scratch_path(spark, "retention-stage"))
    return sinks.read_logs(spark, path).select("id", "timestamp", "level", "app_name")


@register(
    "dashboard_rollup",
    fx.duck_with("logs")
    + f"""SELECT CASE WHEN GROUPING(app_name) = 0 THEN 'app' ELSE 'total' END AS scope, app_name,
 count(*) AS log_count, count(*) FILTER (WHERE level = 'Error') AS error_count,
 count(*) FILTER (WHERE level = 'Warning') AS warning_count,
 CAST(count(*) FILTER (WHERE timestamp > {H1_SQL}) AS DOUBLE) / 60.0 AS logs_per_minute
FROM logs WHERE timestamp > {H24_SQL}
GROUP BY GROUPING SETS ((app_name), ())""",
)
def q_dashboard_rollup(spark, sf_dir):
    return stats.dashboard(fx.logs(spark, sf_dir), AS_OF)


@register("top_apps_from_rollup", ORACLE["top_apps"])
def q_top_apps_from_rollup(spark, sf_dir):
    """A6 from the dashboard's one scan."""
    return stats.top_apps_from(stats.dashboard(fx.logs(spark, sf_dir), AS_OF)).select("app_name", "log_count", "error_count")


@register(
    "request_log_levels",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG
    + "SELECT id, status_code, exception IS NOT NULL AS has_exception, level, message FROM request_log",
)
def q_request_log_levels(spark, sf_dir):
    """E9 + E12 (+ F16): level and summary line per logged request."""
    logged = reqs.request_log(fx.requests(spark, sf_dir))
    return logged.select("id", "status_code", F.col("exception").isNotNull().alias("has_exception"), "level",
                         "message")


@register(
    "request_log_redacted",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG
    + "SELECT id, request_path, exception FROM request_log WHERE request_path LIKE '%=***%' OR exception LIKE '%(truncated)'",
)
def q_request_log_redacted(spark, sf_dir):
    """E10 + E11: requests whose query string was redacted or whose stack trace was cut."""
    logged = reqs.request_log(fx.requests(spark, sf_dir))
    return logged.where(F.col("request_path").contains("=***") | F.col("exception").endswith("(truncated)")).select(
        "id", "request_path", "exception")


@register("ingest_to_table", ORACLE["ingest_accepted"])
def q_ingest_to_table(spark, sf_dir):
    """S4 + J1/J2 + S6 as a batch job: classified once into a stage, then stored."""
    base = scratch_path(spark, "ingest-job")
    run_batch_ingest(spark, fx.raw_logs(spark, sf_dir), fx.projects(spark, sf_dir), f"{base}/logs", f"{base}/rejected",
                     f"{base}/stage")
    return sinks.read_logs(spark, f"{base}/logs").select(*[f.name for f in LOGS_SCHEMA.fields])


@register("stream_rate_audit_first_rejected", ORACLE["rate_audit"])
def q_stream_rate_audit_first_rejected(spark, sf_dir):
    """T5 on a stream with the first rejected arrival, drained in out-of-order micro-batches."""
    base = scratch_path(spark, "stream-rate-first")
    src = reqs.request_log(fx.requests(spark, sf_dir, spread=True))
    _stage_input(src, f"{base}/app_logs")
    _await(s_rate.start_rate_audit(spark, _stream(spark, src.schema, f"{base}/app_logs"), f"{base}/audit",
                                   f"{base}/_checkpoint", available_now=True))
    return s_rate.audit(spark.read.parquet(f"{base}/audit"))


@register(
    "permitted_requests",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG
    + """SELECT id, timestamp FROM request_log
QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL '1 minutes', timestamp, TIMESTAMP '1970-01-01') ORDER BY timestamp, id) <= 2""",
)
def q_permitted_requests(spark, sf_dir):
    """T5: the requests that a limiter of two a minute lets through."""
    logged = reqs.request_log(fx.requests(spark, sf_dir))
    return reqs.permitted_requests(logged, permit=2, window_minutes=1).select("id", "timestamp")


@register(
    "log_page_deep",
    fx.duck_with("logs") + "SELECT id, timestamp, level FROM logs ORDER BY timestamp DESC, id LIMIT 500 OFFSET 2000",
)
def q_log_page_deep(spark, sf_dir):
    """K3 past the map-side limit: the page is found by counts."""
    return search.log_page(fx.logs(spark, sf_dir), None, page=5, page_size=500).select("id", "timestamp", "level")


@register(
    "log_page_after",
    fx.duck_with("logs")
    + """SELECT id, timestamp, level FROM logs WHERE timestamp < TIMESTAMP '2024-01-15 12:00:00'
ORDER BY timestamp DESC, id LIMIT 100""",
)
def q_log_page_after(spark, sf_dir):
    """K3 by keyset: the page after a given (time, id)."""
    last = "\uffff"  # after every id of that instant
    return search.log_page_after(fx.logs(spark, sf_dir), None, "2024-01-15 12:00:00", last, 100).select("id", "timestamp", "level")


@register("trace_summary_one", fx.duck_with("logs") + """SELECT trace_id, CAST(count(*) AS BIGINT) AS entry_count,
 bool_or(level IN ('Error', 'Fatal')) AS has_errors FROM logs WHERE trace_id = 'trace-long' GROUP BY trace_id""")
def q_trace_summary_one(spark, sf_dir):
    return traces.trace_summary(fx.logs(spark, sf_dir), "trace-long").select("trace_id", "entry_count", "has_errors")


# ---------------------------------------------------------------- storage that survives re-runs


_STORED_COLS = ["id", "timestamp", "level", "app_name"]


@register("ingest_to_table_rerun", ORACLE["ingest_accepted"])
def q_ingest_to_table_rerun(spark, sf_dir):
    """The same job run twice stores each record once."""
    base = scratch_path(spark, "ingest-rerun")
    for _ in range(2):
        run_batch_ingest(spark, fx.raw_logs(spark, sf_dir), fx.projects(spark, sf_dir), f"{base}/logs",
                         f"{base}/rejected", f"{base}/stage")
    return sinks.read_logs(spark, f"{base}/logs").select(*[f.name for f in LOGS_SCHEMA.fields])


def _landed(df: DataFrame, path: str) -> None:
    """Rows of the landing sink, as two micro-batches write them."""
    for k in (0, 1):
        s_ingest.write_batch_partitions(df.where(F.col("id").cast("bigint") % 2 == k), path, k)


@register("compact_mixed_month", fx.duck_with("logs") + f"SELECT {_cols(_STORED_COLS)} FROM logs")
def q_compact_mixed_month(spark, sf_dir):
    """Months that hold batch-ingested rows take in what streamed, twice."""
    base = scratch_path(spark, "compact")
    rows = fx.logs(spark, sf_dir)
    sinks.write_logs(rows.where("id % 3 = 0"), f"{base}/table")
    _landed(rows.where("id % 3 <> 1 OR id % 2 = 0"), f"{base}/landing")
    sinks.write_logs(rows.where("id % 3 = 1 AND id % 2 = 1"), f"{base}/table")
    for run in range(2):
        for (month,) in spark.read.parquet(f"{base}/landing").select("month").distinct().collect():
            sinks.compact_month(spark, f"{base}/landing", f"{base}/table", month, f"{base}/stage-{run}-{month}")
    return sinks.read_logs(spark, f"{base}/table").select(*_STORED_COLS)


@register(
    "compact_app_logs",
    fx.duck_with("requests") + _DUCK_REQUEST_LOG + "SELECT id, timestamp, level, status_code, duration_ms FROM request_log",
)
def q_compact_app_logs(spark, sf_dir):
    """S7 + T2: request-log batches folded into the stored request log."""
    base = scratch_path(spark, "compact-app")
    _landed(reqs.request_log(fx.requests(spark, sf_dir)), f"{base}/landing")
    for (month,) in spark.read.parquet(f"{base}/landing").select("month").distinct().collect():
        sinks.compact_month(spark, f"{base}/landing", f"{base}/table", month, f"{base}/stage-{month}", app_logs=True)
    return sinks.read_app_logs(spark, f"{base}/table").select("id", "timestamp", "level", "status_code", "duration_ms")


_DUCK_KEPT = fx.duck_with("logs") + "SELECT id, timestamp, level, app_name FROM logs WHERE timestamp >= TIMESTAMP '2024-01-21 00:00:00'"


@register("retention_after_append", _DUCK_KEPT)
def q_retention_after_append(spark, sf_dir):
    """M1 run again after more rows arrived: they are judged, not lost."""
    base = scratch_path(spark, "retention-append")
    rows = fx.logs(spark, sf_dir)
    for k in (0, 1):
        sinks.write_logs(rows.where(F.col("id").cast("bigint") % 2 == k), f"{base}/logs")
        retention.apply_retention(spark, f"{base}/logs", AS_OF, 10, f"{base}/stage")
    return sinks.read_logs(spark, f"{base}/logs").select(*_STORED_COLS)


@register("retention_landing", _DUCK_KEPT)
def q_retention_landing(spark, sf_dir):
    """M1 on what the stream writes; the next batch can be written and read afterwards."""
    base = scratch_path(spark, "retention-landing")
    rows = fx.logs(spark, sf_dir)
    _landed(rows.where("id % 5 <> 0"), f"{base}/landing")
    retention.apply_retention(spark, f"{base}/landing", AS_OF, 10, f"{base}/stage")
    late = rows.where("id % 5 = 0 AND timestamp >= TIMESTAMP_NTZ'2024-01-21 00:00:00'")
    s_ingest.write_batch_partitions(late, f"{base}/landing", 2)
    return spark.read.parquet(f"{base}/landing").select(*_STORED_COLS)


@register(
    "retention_ttl_stored",
    fx.duck_with("logs")
    + "SELECT id, timestamp, level, app_name FROM logs WHERE created_at > TIMESTAMP '2024-01-24 00:00:00'",
)
def q_retention_ttl_stored(spark, sf_dir):
    """M3 as a job on the stored table."""
    base = scratch_path(spark, "ttl")
    sinks.write_logs(fx.logs(spark, sf_dir), f"{base}/logs", rewrite=True)
    retention.apply_ttl(spark, f"{base}/logs", AS_OF, f"{base}/stage", ttl_days=7)
    return sinks.read_logs(spark, f"{base}/logs").select(*_STORED_COLS)


@register("delete_all_stored", fx.duck_with("logs") + "SELECT count(*) - count(*) AS rows_left, CAST(1 AS BIGINT) AS rows_after_insert FROM logs")
def q_delete_all_stored(spark, sf_dir):
    """M2 on the stored table: nothing is left, and it takes rows again."""
    path = scratch_path(spark, "delete-all")
    rows = fx.logs(spark, sf_dir)
    sinks.write_logs(rows, path)
    retention.delete_all_stored(spark, path)
    left = sinks.read_logs(spark, path).agg(F.count(F.lit(1)).alias("rows_left"))
    again = scratch_path(spark, "delete-all-left")
    left.write.parquet(again)
    sinks.write_logs(rows.orderBy("id").limit(1), path)
    after = sinks.read_logs(spark, path).agg(F.count(F.lit(1)).alias("rows_after_insert"))
    return spark.read.parquet(again).join(after, how="cross")  # one row each


@register(
    "schema_evolution",
    fx.duck_with("logs")
    + """SELECT id, app_name, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'production' ELSE environment END AS environment,
 CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 0 ELSE status_code END AS status_code,
 CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '{}' ELSE metadata END AS metadata FROM logs""",
)
def q_schema_evolution(spark, sf_dir):
    """Rows written before some columns existed get their defaults."""
    path = scratch_path(spark, "evolution")
    rows = fx.logs(spark, sf_dir)
    old = rows.where("id % 2 = 0").select("id", "timestamp", "level", "app_name", "message")
    sinks.write_logs(old, path)
    sinks.write_logs(rows.where("id % 2 = 1"), path)
    return sinks.read_logs(spark, path).select("id", "app_name", "environment", "status_code", "metadata")


@register(
    "stored_projects",
    fx.duck_with("projects")
    + f"""SELECT id, CASE WHEN id = 's1' THEN 'Renamed' ELSE name END AS name, api_key, created_at, expires_at FROM projects
WHERE id <> 'p5' UNION ALL SELECT 'p-new', 'NEW PROJECT', 'demo_key_new_0123456789', {_AS_OF_TS}, {_AS_OF_TS} + INTERVAL 30 DAY""",
)
def q_stored_projects(spark, sf_dir):
    """S3 + M4-M6: a stored project table, renamed, deleted from and inserted into, each time as
    a new version."""
    base = scratch_path(spark, "projects")
    sinks.write_table(fx.projects(spark, sf_dir), f"{base}/v0")
    now = lambda k: sinks.read_projects(spark, f"{base}/v{k}")
    sinks.write_table(proj.rename_project(now(0), "s1", "Renamed"), f"{base}/v1")
    sinks.write_table(proj.delete_project(now(1), "p5"), f"{base}/v2")
    sinks.write_table(proj.insert_project(spark, now(2), "p-new", "NEW PROJECT", "demo_key_new_0123456789", AS_OF, 30), f"{base}/v3")
    return now(3)


@register("export_json_file", ORACLE["export_json_records"])
def q_export_json_file(spark, sf_dir):
    """Written as JSON Lines and read back."""
    path = scratch_path(spark, "export-json")
    records = export.json_records(_selected(spark, sf_dir))
    sinks.export_json(records, path)
    return spark.read.schema(records.schema).json(path)


@register(
    "export_csv_file",
    fx.duck_with("logs") + _DUCK_SELECTED
    + """SELECT id, level, app_name AS "appName", coalesce(message, '') AS message, metadata,
 CASE WHEN duration_ms = 0 THEN NULL ELSE duration_ms END AS "durationMs" FROM selected""",
)
def q_export_csv_file(spark, sf_dir):
    """The CSV files with their header, read back by name."""
    path = scratch_path(spark, "export-csv")
    sinks.export_csv(export.csv_lines(_selected(spark, sf_dir)), path, export.csv_header_line())
    back = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return back.select("id", "level", "appName", F.coalesce("message", F.lit("")).alias("message"), "metadata", F.col("durationMs").cast("double"))


@register(
    "export_lines_file",
    ORACLE["export_lines"].replace("SELECT id, '['", "SELECT '['"),
)
def q_export_lines_file(spark, sf_dir):
    """Written as text and read back."""
    path = scratch_path(spark, "export-lines")
    sinks.export_text(export.log_lines(_selected(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register(
    "trace_lookup_bounded",
    fx.duck_with("logs")
    + _TRACE_CTE.format(extra="AND trace_id = 'trace-long' AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-12'")
    + "SELECT id, entry_no, truncated FROM capped",
)
def q_trace_lookup_bounded(spark, sf_dir):
    """F17 on the stored table with time bounds: other months are not opened."""
    path = scratch_path(spark, "stored-trace")
    sinks.write_logs(fx.logs(spark, sf_dir), path, rewrite=True)
    rows = traces.trace_timeline(sinks.read_logs(spark, path), "trace-long", time_from="2024-01-10", time_to="2024-01-12")
    return rows.select("id", "entry_no", "truncated")


# ---------------------------------------------------------------- tables under a manifest
# Jobs that die half-way, writers beside each other and repeated steps, on the whole log table.


def _appended(rows: DataFrame, table: ManifestTable, parts: int = 3) -> ManifestTable:
    for k in range(parts):
        table.append(rows.where(F.col("id").cast("bigint") % parts == k), ("load", k), spread=True)
    return table


@register(
    "stream_ingest_batch",
    ORACLE["ingest_batch"].replace("SELECT CAST(r.raw_id", f"SELECT {_cols(_INGEST_COLS)} FROM (SELECT CAST(r.raw_id", 1) + ")",
)
def q_stream_ingest_batch(spark, sf_dir):
    """T1 for S5: batch bodies on the stream, each accepted or rejected as a whole, into a table
    under a manifest."""
    base = scratch_path(spark, "stream-ingest-batch")
    _stage_input(fx.raw_batches(spark, sf_dir, spread=True), f"{base}/raw", dealt=False)
    logs = logs_table(spark, f"{base}/logs")
    _await(s_ingest.start_log_ingest(
        spark, f"{base}/raw", lambda: fx.projects(spark, sf_dir), logs, rejections_table(spark, f"{base}/rejected"),
        f"{base}/_checkpoint", available_now=True, envelopes=True,
        max_bytes_per_trigger=s_ingest.drain_trigger(spark, f"{base}/raw", 4 * STREAM_TRIGGER),
    ))
    return logs.read().select(*_INGEST_COLS)


@register("stream_ingest_table", ORACLE["stream_ingest"])
def q_stream_ingest_table(spark, sf_dir):
    """T1 into a table under a manifest, compacted while the stream is read and once more afterwards."""
    base = scratch_path(spark, "stream-ingest-table")
    _stage_input(fx.raw_logs(spark, sf_dir, spread=True), f"{base}/raw")
    logs = logs_table(spark, f"{base}/logs")
    q = s_ingest.start_log_ingest(
        spark, f"{base}/raw", lambda: fx.projects(spark, sf_dir), logs, rejections_table(spark, f"{base}/rejected"),
        f"{base}/_checkpoint", available_now=True, max_bytes_per_trigger=s_ingest.drain_trigger(spark, f"{base}/raw", 4 * STREAM_TRIGGER),
    )
    s_ingest.compact_beside(q, logs)
    _await(q)
    logs.compact()
    return logs.read().select(*_INGEST_COLS)


@register(
    "table_ttl_after_stopped_delete",
    fx.duck_with("logs") + f"SELECT {_cols(_STORED_COLS)} FROM logs WHERE created_at > TIMESTAMP '2024-01-24 00:00:00'",
)
def q_table_ttl_after_stopped_delete(spark, sf_dir):
    """M1 that dies before its commit, rows that arrive then, and M3: every row is judged once."""
    rows = fx.logs(spark, sf_dir)
    table = _appended(rows.where("id % 5 <> 0"), logs_table(spark, scratch_path(spark, "table-ttl")))
    table.write_files(table.read().where("timestamp >= TIMESTAMP_NTZ'2024-01-21 00:00:00'"), 1)  # and no commit
    table.append(rows.where("id % 5 = 0"), spread=True)
    table.expire(AS_OF, 7)
    return table.read().select(*_STORED_COLS)


@register(
    "table_delete_all_after_stopped_delete",
    fx.duck_with("logs") + f"SELECT {_cols(_STORED_COLS)} FROM logs WHERE CAST(id AS BIGINT) % 5 = 0 AND timestamp >= TIMESTAMP '2024-01-21 00:00:00'",
)
def q_table_delete_all_after_stopped_delete(spark, sf_dir):
    """M2 after an M1 that died: nothing comes back, and what is appended next is kept by M1."""
    rows = fx.logs(spark, sf_dir)
    table = _appended(rows.where("id % 5 <> 0"), logs_table(spark, scratch_path(spark, "table-delete-all")))
    table.write_files(table.read().where("timestamp >= TIMESTAMP_NTZ'2024-01-21 00:00:00'"), 1)  # and no commit
    table.delete_all()
    table.append(rows.where("id % 5 = 0"), spread=True)
    table.delete_older_than(AS_OF, 10)
    return table.read().select(*_STORED_COLS)


@register("table_compact_while_arriving", fx.duck_with("logs") + f"SELECT {_cols(_STORED_COLS)} FROM logs")
def q_table_compact_while_arriving(spark, sf_dir):
    """S12 beside a writer: the files that a compaction has read make way for its own, a batch
    that is committed in between stays, and a repeated batch counts once."""
    rows = fx.logs(spark, sf_dir)
    table = _appended(rows.where("id % 4 <> 3"), logs_table(spark, scratch_path(spark, "table-compact")))
    read = table.snapshot()
    merged = table.write_files(table.scan(list(read.files)), 2)
    for _ in range(2):
        table.append(rows.where("id % 4 = 3"), ("stream", 0), spread=True)  # arrives meanwhile, twice
    table.commit(read, merged, list(read.files))
    return table.read().select(*_STORED_COLS)


@register(
    "table_earlier_version",
    fx.duck_with("logs") + """SELECT count(*) FILTER (WHERE CAST(id AS BIGINT) % 3 <= 1) AS before, count(*) AS whole,
 count(*) FILTER (WHERE timestamp >= TIMESTAMP '2024-01-21 00:00:00') AS after FROM logs""",
)
def q_table_earlier_version(spark, sf_dir):
    """Readers of earlier versions see them as they were, also after deletes and a vacuum that
    keeps them."""
    table = _appended(fx.logs(spark, sf_dir), logs_table(spark, scratch_path(spark, "table-versions")))
    table.compact()
    table.delete_older_than(AS_OF, 10)
    table.vacuum(orphan_seconds=0)
    n = lambda v: table.read(table.snapshot(v)).agg(F.count(F.lit(1)).alias("n"))
    at = [n(v).withColumn("v", F.lit(v)) for v in (2, 3, 5)]
    one = lambda v, name: F.sum(F.when(F.col("v") == v, F.col("n"))).alias(name)
    return at[0].unionByName(at[1]).unionByName(at[2]).agg(one(2, "before"), one(3, "whole"), one(5, "after"))


def _with_rollup(spark, sf_dir, name: str) -> tuple[ManifestTable, ManifestTable]:
    base = scratch_path(spark, name)
    logs, counts = logs_table(spark, f"{base}/logs"), rollup.rollup_table(spark, f"{base}/minutes")
    for k in (0, 1, 1, 2):  # one step twice
        rollup.append_with_rollup(logs, counts, fx.logs(spark, sf_dir).where(F.col("id").cast("bigint") % 3 == k), ("load", k))
    rollup.fold(counts)
    return logs, counts


@register("log_stats_maintained", ORACLE["log_stats"])
def q_log_stats_maintained(spark, sf_dir):
    """A2-A5 from minute counts that ingest maintains, and the log rows of two minutes."""
    return rollup.log_stats(*_with_rollup(spark, sf_dir, "stats-maintained"), AS_OF)


@register("top_apps_maintained", ORACLE["top_apps"])
def q_top_apps_maintained(spark, sf_dir):
    """A6 from the maintained minute counts."""
    return rollup.top_apps(*_with_rollup(spark, sf_dir, "apps-maintained"), AS_OF)


@register("log_patterns_maintained", ORACLE["log_patterns"])
def q_log_patterns_maintained(spark, sf_dir):
    """A7 from pattern counts per hour that ingest maintains, and the log rows of one hour."""
    base = scratch_path(spark, "patterns-maintained")
    logs, hours = logs_table(spark, f"{base}/logs"), rollup.pattern_table(spark, f"{base}/hours")
    minutes = rollup.rollup_table(spark, f"{base}/minutes")
    for k in range(3):
        rows = fx.logs(spark, sf_dir).where(F.col("id").cast("bigint") % 3 == k)
        rollup.append_with_rollup(logs, minutes, rows, ("load", k), hours)
    rollup.fold(hours)
    return rollup.log_patterns(logs, hours, AS_OF, hours=720, min_count=2, limit=50)


@register("trace_lookup_indexed", ORACLE["trace_lookup"])
def q_trace_lookup_indexed(spark, sf_dir):
    """F17 without time bounds: the index tells the files of a trace, no other is opened."""
    table = _appended(fx.logs(spark, sf_dir), logs_table(spark, scratch_path(spark, "trace-index"), (TRACE_INDEX,)))
    return traces.trace_timeline(table.read_holding(TRACE_INDEX, [LOOKUP_TRACE]), LOOKUP_TRACE)


@register("log_search_indexed", ORACLE["log_search_literal"])
def q_log_search_indexed(spark, sf_dir):
    """files without all three-character parts of the search text are not opened."""
    rows = fx.logs(spark, sf_dir).repartitionByRange(8, "level", "id")
    table = logs_table(spark, scratch_path(spark, "message-index"), (MESSAGE_INDEX,))
    table.append(rows)
    found = table.read_holding(MESSAGE_INDEX, grams("100%_OK"))
    return search.filter_logs(found, LogFilter(search="100%_OK")).select("id", "timestamp", "message")


TAILS = {
    "errors": LogFilter(levels="Error,Fatal"),
    "svc-3": TAIL_FILTER,
    "slow posts": LogFilter(request_method="POST", status_min=400),
    "nobody": LogFilter(app_name="none such"),
}
_TAIL_SQL = {
    "errors": "level IN ('Error', 'Fatal')",
    "svc-3": "level IN ('Warning', 'Error', 'Fatal') AND app_name = 'svc-3'",
    "slow posts": "request_method = 'POST' AND status_code >= 400",
}


@register(
    "stream_tails",
    fx.duck_with("logs") + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{name}' AS tail, id, timestamp, level FROM logs WHERE {cond} ORDER BY timestamp DESC, id LIMIT 100)"
        for name, cond in _TAIL_SQL.items()),
)
def q_stream_tails(spark, sf_dir):
    """T3 for many viewers: all filters in one pass over each micro-batch."""
    base = scratch_path(spark, "stream-tails")
    _stage_input(fx.logs(spark, sf_dir, spread=True), f"{base}/logs")
    stream = _stream(spark, LOGS_SCHEMA, f"{base}/logs")
    _await(s_tail.start_tails(spark, stream, TAILS, f"{base}/tails", f"{base}/_checkpoint", available_now=True))
    schema = T.StructType([*LOGS_SCHEMA.fields, T.StructField("tail", T.StringType())])
    return s_tail.read_tail(spark, f"{base}/tails", schema).select("tail", "id", "timestamp", "level")


@register(
    "ingest_as_of",
    fx.duck_with("raw_logs", "project_history")
    + f""", ok AS (SELECT * FROM raw_logs WHERE {_DUCK_OBJECT}), dated AS (
 SELECT r.raw_id, h.id, h.name, h.expires_at, row_number() OVER (PARTITION BY r.raw_id ORDER BY h.created_at DESC, h.id DESC) AS rn
 FROM ok r JOIN project_history h ON r.api_key = h.api_key AND h.created_at <= r.received_at)
SELECT CAST(r.raw_id AS VARCHAR) AS id, r.received_at AS timestamp, p.id AS project_id, p.name AS project_name
FROM ok r JOIN dated p ON r.raw_id = p.raw_id AND p.rn = 1 WHERE {_DUCK_VALID}""",
)
def q_ingest_as_of(spark, sf_dir):
    """J1/J2 by the key history: a record meets the project that its key had when it was received."""
    classified = enrich.ingest_records_as_of(fx.raw_logs(spark, sf_dir), fx.project_history(spark, sf_dir))
    return enrich.to_logs(classified).select("id", "timestamp", "project_id", "project_name")
