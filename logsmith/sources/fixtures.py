"""Fixture views derived from the driver's test tables (FIXTURES.md §2).

One SQL text per view, rendered for Spark (``spark.sql(text, events=df)``, no catalog
registration) and for DuckDB (the oracle CTEs). Every row of a view comes from a row of a
given table, so the work of each query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The reference time of every relative-time fixture query.
AS_OF = "2024-01-31 00:00:00"

_LOGS = """
SELECT CAST(event_id AS STRING) AS id,
 {TSMS_ts} AS timestamp,
 CASE WHEN event_type='error' AND value>=100 THEN 'Fatal' WHEN event_type='error' THEN 'Error'
      WHEN event_type='purchase' AND value>=100 THEN 'Warning' WHEN event_type IN ('purchase','signup') THEN 'Info'
      WHEN event_type='click' THEN 'Debug' ELSE 'Trace' END AS level,
 concat('svc-', CAST(user_id % 12 AS STRING)) AS app_name,
 CASE WHEN event_type='error' THEN concat('Connection failed to db-server-', CAST(user_id AS STRING), ': timeout after ', CAST(CAST(floor(value) AS BIGINT) AS STRING), 'ms')
      WHEN event_type='purchase' THEN concat('Order ', CAST(event_id AS STRING), ' paid 100%_OK by user_', CAST(user_id AS STRING))
      WHEN event_type='signup' THEN concat('Kullanıcı ', CAST(user_id AS STRING), ' kaydı tamamlandı')
      ELSE concat('User ', CAST(user_id AS STRING), ' ', event_type) END AS message,
 props AS metadata,
 CASE WHEN event_type='error' AND value>=100 THEN 'TimeoutException' WHEN event_type='error' THEN 'ConnectionException' ELSE '' END AS exception_type,
 CASE WHEN event_type='error' THEN concat('attempt ', CAST(event_id % 5 AS STRING), ' failed') ELSE '' END AS exception_message,
 '' AS exception_stacktrace,
 concat('Handler', CAST(event_id % 6 AS STRING)) AS source,
 CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS request_method,
 concat('/api/', event_type, '/', CAST(user_id AS STRING), CASE WHEN event_id % 10 = 0 THEN concat('?page=1&Token=t', CAST(event_id AS STRING), '&x=2') ELSE '' END) AS request_path,
 CAST(CASE WHEN event_type='error' THEN 500 + event_id % 4 WHEN event_type='purchase' AND value>=100 THEN 404 WHEN event_type='view' THEN 0 ELSE 200 END AS INT) AS status_code,
 CASE event_id % 101 WHEN 0 THEN 12345678.5 WHEN 1 THEN 0.0001 ELSE value END AS duration_ms,
 concat('user_', CAST(user_id AS STRING)) AS user_id,
 CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 11 = 1 THEN 'trace-long' ELSE concat('trace-', CAST(event_id - event_id % 8 AS STRING)) END AS trace_id,
 CASE WHEN event_id % 3 <> 0 THEN concat('span-', CAST(event_id % 8 AS STRING)) ELSE '' END AS span_id,
 concat('host-', CAST(user_id % 4 AS STRING)) AS host,
 CASE user_id % 5 WHEN 0 THEN 'staging' WHEN 1 THEN 'development' WHEN 2 THEN '' ELSE 'production' END AS environment,
 concat('p', CAST(user_id % 25 AS STRING)) AS project_id,
 concat('NATION_', CAST(user_id % 25 AS STRING)) AS project_name,
 {TSMS_ts} AS created_at
FROM {events}
"""

_PROJECTS = """
SELECT concat('p', CAST(n_nationkey AS STRING)) AS id,
 n_name AS name,
 concat('demo_key_', CAST(n_nationkey AS STRING)) AS api_key,
 {TS}'2023-12-01 00:00:00' AS created_at,
 CASE n_regionkey WHEN 0 THEN {TS}'2024-01-10 00:00:00' WHEN 1 THEN {TS}'2024-02-05 00:00:00' ELSE NULL END AS expires_at
FROM {nation}
UNION ALL
SELECT concat('s', CAST(s_suppkey AS STRING)) AS id,
 s_name AS name,
 concat('demo_key_s', CAST(s_suppkey AS STRING)) AS api_key,
 {TS}'2023-12-15 00:00:00' AS created_at,
 CASE s_nationkey % 3 WHEN 0 THEN {TS}'2024-01-20 00:00:00' WHEN 1 THEN {TS}'2024-02-03 12:00:00' ELSE NULL END AS expires_at
FROM {supplier}
"""

_RAW_LOGS = """
SELECT event_id AS raw_id,
 {TSMS_ts} AS received_at,
 concat('demo_key_', CAST(user_id % 30 AS STRING)) AS api_key,
 concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS client_ip,
 CASE event_id % 97 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL WHEN 3 THEN 'null' WHEN 4 THEN '{{"level":' ELSE
 concat('{{"level":"', CASE event_id % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'warning' WHEN 2 THEN '4' WHEN 3 THEN '9' WHEN 4 THEN 'bogus' WHEN 5 THEN CASE event_id % 4 WHEN 0 THEN '04' WHEN 1 THEN '+4' ELSE 'Fatal' END ELSE 'info' END,
   '","message":"event ', CAST(event_id AS STRING), '","appName":"svc-', CAST(user_id % 12 AS STRING), '"',
   CASE WHEN event_id % 26 = 13 THEN ',"metadata":"a note"' WHEN event_id % 2 = 0 THEN concat(',"metadata":', props) ELSE '' END,
   CASE WHEN event_id % 3 = 0 THEN ',"host":"h1","statusCode":200' ELSE '' END,
   CASE WHEN event_id % 5 = 0 THEN ',"environment":"staging"' ELSE '' END, '}}') END AS body
FROM {events}
"""

_APP_LOGS = """
SELECT id, timestamp,
 CASE WHEN status_code >= 500 THEN 'Error' WHEN status_code >= 400 THEN 'Warning' ELSE 'Information' END AS level,
 'HTTP' AS category,
 concat(request_method, ' ', request_path, ' -> ', CAST(status_code AS STRING), ' (', CAST(CAST(floor(duration_ms) AS BIGINT) AS STRING), 'ms)') AS message,
 exception_message AS exception, request_method, request_path, status_code, duration_ms, created_at
FROM {logs}
"""

_SPARK_TSMS = (
    "timestampadd(MILLISECOND, floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000),"
    " TIMESTAMP_NTZ'1970-01-01 00:00:00')"
)


def _spark_text(text: str) -> str:
    return text.replace("{TSMS_ts}", _SPARK_TSMS).replace("{TS}", "TIMESTAMP_NTZ")


def duck_text(text: str, **tables: str) -> str:
    out = text.replace("{TSMS_ts}", "date_trunc('millisecond', ts)").replace("{TS}", "TIMESTAMP")
    out = out.replace("{{", "\x00").replace("}}", "\x01")
    for name, value in tables.items():
        out = out.replace("{" + name + "}", value)
    return out.replace("\x00", "{").replace("\x01", "}")


# Declared schemas of the driver's input tables used by the views (declared,
# not inferred: no footer-reading job per scan).
SOURCE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SOURCE_SCHEMAS:
        reader = reader.schema(SOURCE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shares(df: DataFrame) -> DataFrame:
    """As many partitions as shuffle partitions, each a random share of the rows: by a hash of the
    whole row, which needs no sort and is the same in every attempt of a task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*df.columns))


def _events(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    """``spread``: dealt out before a view computes anything, however few the splits of the file."""
    events = table(spark, sf_dir, "events")
    return shares(events) if spread else events


def logs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``logs`` (one row per ``events`` row)."""
    return spark.sql(_spark_text(_LOGS), events=_events(spark, sf_dir, spread))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``projects``: one row per ``nation`` row (the keys used by ``raw_logs``) plus one per
    ``supplier`` row (keys ``demo_key_s<n>``), so the registry grows with the data."""
    return spark.sql(_spark_text(_PROJECTS), nation=table(spark, sf_dir, "nation"),
                     supplier=table(spark, sf_dir, "supplier"))


def raw_logs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``raw_logs`` ingest input (one JSON body per ``events`` row)."""
    return spark.sql(_spark_text(_RAW_LOGS), events=_events(spark, sf_dir, spread))


def app_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app_logs`` request log derived from ``logs``."""
    return spark.sql(_spark_text(_APP_LOGS), logs=logs(spark, sf_dir))


def duck_views() -> dict[str, str]:
    """DuckDB text of the four views, to be used as CTEs over the driver's views."""
    return {
        "logs": duck_text(_LOGS, events="events"),
        "projects": duck_text(_PROJECTS, nation="nation", supplier="supplier"),
        "raw_logs": duck_text(_RAW_LOGS, events="events"),
        "app_logs": duck_text(_APP_LOGS, logs="logs"),
    }


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named views (dependencies first)."""
    views = duck_views()
    views["raw_batches"] = DUCK_RAW_BATCHES
    views["project_history"] = duck_project_history()
    views["requests"] = duck_requests()
    deps = {"app_logs": ["logs"], "raw_batches": ["raw_logs"], "project_history": ["projects"], "requests": ["logs"]}
    order: list[str] = []
    for n in names:
        for d in deps.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n"


# Batch envelopes: raw records of one key, in blocks of 256 consecutive ids, posted as one
# ``{"logs": [...]}`` body (so every group holds at most 256 records).
BATCH_BLOCK = 256


def raw_batches(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``raw_batches``: ``raw_id`` (first id of the batch), ``received_at`` (last), ``api_key``,
    ``client_ip`` (smallest), ``body`` (envelope, records in id order)."""
    # records that parse; every fifth block carries a null element, every seventh is empty
    raw = raw_logs(spark, sf_dir, spread).where("body LIKE '{%}'")
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("raw_id", "body"))), lambda s: s["body"])
    block = F.col("_blk")
    inside = F.when(block % 7 == 2, F.lit("")).otherwise(
        F.concat(F.array_join(bodies, ","), F.when(block % 5 == 3, F.lit(",null")).otherwise(F.lit(""))))
    return (
        raw.groupBy("api_key", F.floor(F.col("raw_id") / BATCH_BLOCK).alias("_blk"))
        .agg(
            F.min("raw_id").alias("raw_id"),
            F.max("received_at").alias("received_at"),
            F.min("client_ip").alias("client_ip"),
            F.concat(F.lit('{"logs":['), inside, F.lit("]}")).alias("body"),
        )
        .select("raw_id", "received_at", "api_key", "client_ip", "body")
    )


DUCK_RAW_BATCHES = f"""SELECT min(raw_id) AS raw_id, max(received_at) AS received_at, api_key, min(client_ip) AS client_ip,
 '{{"logs":[' || CASE WHEN raw_id // {BATCH_BLOCK} % 7 = 2 THEN '' ELSE string_agg(body, ',' ORDER BY raw_id)
  || CASE WHEN raw_id // {BATCH_BLOCK} % 5 = 3 THEN ',null' ELSE '' END END || ']}}' AS body
FROM raw_logs WHERE body LIKE '{{%}}' GROUP BY api_key, raw_id // {BATCH_BLOCK}"""

# Project history: the base projects plus a second registration of EVERY key — later
# than the first for region-2 nation keys and even supplier keys (the new one wins),
# earlier for all others (the old one stays) — for last-write-wins dedupe.
_PROJECT_VERSIONS = """
SELECT concat('p', CAST(n_nationkey AS STRING), '-v2') AS id,
 concat(n_name, ' (renamed)') AS name,
 concat('demo_key_', CAST(n_nationkey AS STRING)) AS api_key,
 CASE n_regionkey WHEN 2 THEN {TS}'2024-01-15 00:00:00' ELSE {TS}'2023-11-01 00:00:00' END AS created_at,
 CAST(NULL AS TIMESTAMP_NTZ) AS expires_at
FROM {nation}
UNION ALL
SELECT concat('s', CAST(s_suppkey AS STRING), '-v2') AS id,
 concat(s_name, ' (renamed)') AS name,
 concat('demo_key_s', CAST(s_suppkey AS STRING)) AS api_key,
 CASE s_suppkey % 2 WHEN 0 THEN {TS}'2024-01-25 00:00:00' ELSE {TS}'2023-11-01 00:00:00' END AS created_at,
 CAST(NULL AS TIMESTAMP_NTZ) AS expires_at
FROM {supplier}
"""


def project_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(_spark_text(_PROJECT_VERSIONS), nation=table(spark, sf_dir, "nation"),
                      supplier=table(spark, sf_dir, "supplier"))
    return projects(spark, sf_dir).unionByName(extra)


def duck_project_history() -> str:
    text = duck_text(_PROJECT_VERSIONS, nation="nation", supplier="supplier").replace("TIMESTAMP_NTZ", "TIMESTAMP")
    return f"SELECT * FROM projects UNION ALL {text}"


# Request records behind the request log: every ``logs`` row is one request; rows of the
# Trace level are treated as static-file fetches, and error rows carry a stack trace of
# (status - 496) frames so both short and long traces occur.
_REQUESTS = """
SELECT id, timestamp, request_method,
 CASE WHEN level = 'Trace' THEN concat('/images/', user_id, '.png') WHEN CAST(id AS BIGINT) % 89 = 5 THEN NULL ELSE request_path END AS request_path,
 status_code, duration_ms,
 CASE WHEN exception_type <> '' THEN concat(exception_type, ': ', exception_message,
   repeat(concat(chr(10), '   at ', source, '.Handle()'), status_code - 496)) END AS exception
FROM {logs}
"""


def requests(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return spark.sql(_spark_text(_REQUESTS), logs=logs(spark, sf_dir, spread))


def duck_requests() -> str:
    return duck_text(_REQUESTS, logs="logs")
