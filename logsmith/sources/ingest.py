"""JSON ingest: single records (S4) and ``{"logs": [...]}`` batches (S5), with the
coercions of a stored log entry (E2-E8).

Parsing is ``from_json`` with a declared schema (never inferred). ``metadata`` is declared
as STRING, so an object arrives as its compact JSON text; a JSON string, which loses its quotes
that way, is written as JSON again. Bodies that do not parse, are blank or are no object are
kept and flagged (``malformed``) for the quarantine output instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsmith.functions.json import json_text, metadata_text
from logsmith.functions.levels import parse_level
from logsmith.functions.time import to_ms

_S = T.StringType()

# The camelCase fields of an ingest record.
BODY_FIELDS = (
    ("level", _S),
    ("message", _S),
    ("appName", _S),
    ("metadata", _S),
    ("traceId", _S),
    ("spanId", _S),
    ("host", _S),
    ("environment", _S),
    ("exceptionType", _S),
    ("exceptionMessage", _S),
    ("exceptionStacktrace", _S),
    ("source", _S),
    ("requestMethod", _S),
    ("requestPath", _S),
    ("statusCode", T.IntegerType()),
    ("durationMs", T.DoubleType()),
    ("userId", _S),
)
CORRUPT = "_corrupt"
BODY_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in BODY_FIELDS])
_BODY_WITH_CORRUPT = T.StructType(BODY_SCHEMA.fields + [T.StructField(CORRUPT, _S, True)])
BATCH_SCHEMA = T.StructType(
    [T.StructField("logs", T.ArrayType(BODY_SCHEMA, True), True), T.StructField(CORRUPT, _S, True)]
)
_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _not_an_object(body: str) -> Column:
    """Missing, blank, or JSON that is no object (``null``, an array, a scalar)."""
    return ~F.coalesce(F.col(body).rlike(r"^\s*\{"), F.lit(False))


def _may_hold_text(body: str) -> Column:
    """Whether the body can hold a ``metadata`` that is a JSON string: only then is its kind
    worth a second look at the body (an escaped name, as ``met\\u0061data``, counts as one)."""
    return F.col(body).rlike(r'"metadata"\s*:\s*"|\\u')


def parse_records(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``rec`` (parsed body, ``metadata`` as JSON text) and ``malformed``."""
    rec = F.from_json(F.col(body), _BODY_WITH_CORRUPT, _JSON_OPTS)
    kind = F.from_json(F.col(body), "metadata variant")
    parsed = raw.withColumn("rec", rec)
    parsed = parsed.withColumn("malformed", _not_an_object(body) | F.col("rec").isNull() | F.col(f"rec.{CORRUPT}").isNotNull())
    text = F.when(_may_hold_text(body), json_text(F.col("rec.metadata"), kind["metadata"])).otherwise(F.col("rec.metadata"))
    return parsed.withColumn("rec", F.when(F.col("rec").isNotNull(), F.col("rec").withField("metadata", text)))


def parse_envelopes(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``_items`` (the parsed records) and ``malformed``: an envelope that does not
    parse, or that holds a null element, fails as a whole."""
    env = F.from_json(F.col(body), BATCH_SCHEMA, _JSON_OPTS)
    kinds = F.from_json(F.col(body), "logs array<struct<metadata: variant>>")
    bad = _not_an_object(body) | F.col("_env").isNull() | F.col(f"_env.{CORRUPT}").isNotNull()
    bad = bad | F.coalesce(F.exists("_env.logs", lambda x: x.isNull()), F.lit(False))
    both = F.zip_with(
        "_env.logs", "_kinds.logs", lambda r, k: r.withField("metadata", json_text(r["metadata"], k["metadata"])))
    parsed = raw.withColumn("_env", env).withColumn("_kinds", F.when(_may_hold_text(body), kinds)).withColumn("malformed", bad)
    items = F.when(F.col("_kinds").isNotNull(), both).otherwise(F.col("_env.logs"))
    return parsed.withColumn("_items", F.when(~F.col("malformed"), items)).drop("_env", "_kinds")


def explode_batches(classified: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """One row per record of an accepted envelope (``rec``, ``entry_id`` = ``<id_col>-<position>``);
    a rejected envelope stays one row."""
    none = F.array(F.lit(None).cast(BODY_SCHEMA))
    items = F.when(F.col("reject_reason").isNotNull(), none).otherwise(
        F.coalesce(F.col("_items"), F.array().cast(T.ArrayType(BODY_SCHEMA))))
    keep = [c for c in classified.columns if c != "_items"]
    return (
        classified.select(*keep, F.posexplode(items).alias("pos", "rec"))
        .withColumn("entry_id", F.concat(F.col(id_col).cast("string"), F.lit("-"), F.col("pos").cast("string")))
        .drop("pos")
    )


def log_entry_columns(rec: str = "rec", client_ip: Column | None = None) -> list[Column]:
    """Coerced stored fields of a parsed record (project fields not included)."""
    r = lambda f: F.col(f"{rec}.{f}")
    host = F.nullif(r("host"), F.lit(""))
    if client_ip is not None:
        host = F.coalesce(host, client_ip)  # E8: empty host -> client address
    empty = lambda f: F.coalesce(r(f), F.lit(""))
    return [
        parse_level(r("level")).alias("level"),
        empty("appName").alias("app_name"),
        empty("message").alias("message"),
        metadata_text(r("metadata")).alias("metadata"),
        empty("exceptionType").alias("exception_type"),
        empty("exceptionMessage").alias("exception_message"),
        empty("exceptionStacktrace").alias("exception_stacktrace"),
        empty("source").alias("source"),
        empty("requestMethod").alias("request_method"),
        empty("requestPath").alias("request_path"),
        F.coalesce(r("statusCode"), F.lit(0)).alias("status_code"),
        F.coalesce(r("durationMs"), F.lit(0.0)).alias("duration_ms"),
        empty("userId").alias("user_id"),
        empty("traceId").alias("trace_id"),
        empty("spanId").alias("span_id"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(r("environment"), F.lit("production")).alias("environment"),
    ]


def stamp_ms(col: str) -> Column:
    """Millisecond storage precision of ``timestamp`` / ``created_at``."""
    return to_ms(col)
