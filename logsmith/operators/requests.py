"""Request log: records of HTTP requests -> ``app_logs`` rows (E9-E12, F16, S7), a status
summary (E17) and the fixed-window rate audit (T5, batch form).

Everything is a per-row projection except the audit. It ranks by counting: requests per window
and second combine map-side, a running sum over the seconds of a window tells in which of them
request N+1 falls, and only the rows of that second are put in order. No window's requests meet
in one task, whatever the permit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsmith.functions.display import status_class
from logsmith.functions.levels import level_from_status
from logsmith.functions.text import cut_stack, redact_secrets, request_summary
from logsmith.functions.time import EPOCH_SQL
from logsmith.operators.filters import exclude_static
from logsmith.schema import APP_LOGS_SCHEMA

# Rate policies (permits per fixed window); the window is global.
RATE_POLICIES = {
    "login": (5, 15),
    "api": (100, 1),
}


def split_path(col: str = "request_path") -> tuple[Column, Column]:
    """``/a/b?x=1`` -> (``/a/b``, ``?x=1``); no query -> (path, '')."""
    c = F.col(col)
    has_q = F.instr(c, "?") > 0
    path = F.when(has_q, F.substring_index(c, "?", 1)).otherwise(c)
    query = F.when(has_q, F.substr(c, F.instr(c, "?"))).otherwise(F.lit(""))
    return path, query


def request_log(requests: DataFrame, exception: str = "exception", duration_digits: int = 2) -> DataFrame:
    """Request records (``id, timestamp, request_method, request_path`` with query string,
    ``status_code, duration_ms`` and a nullable ``exception`` text) -> ``app_logs`` rows.

    The query string is redacted (E10), static files are dropped (F16), the level comes
    from the status or a recorded exception (E9), the message is the one-line summary
    (E12), stack traces are cut to five lines (E11) and the duration is rounded (S7)."""
    path, query = split_path("request_path")
    logged = requests.withColumn("request_path", F.concat(path, redact_secrets(query)))
    logged = exclude_static(logged, "request_path")
    exc = F.col(exception)
    out = logged.select(
        "id",
        "timestamp",
        level_from_status("status_code", exc).alias("level"),
        F.lit("HTTP").alias("category"),
        request_summary().alias("message"),
        cut_stack(exc).alias("exception"),
        "request_method",
        "request_path",
        "status_code",
        F.round("duration_ms", duration_digits).alias("duration_ms"),
        F.col("timestamp").alias("created_at"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in APP_LOGS_SCHEMA.fields])


def status_summary(app_logs: DataFrame) -> DataFrame:
    """Requests per level and status class (E17) with the mean duration. Stored durations
    have two decimals (S7), so the mean is taken over an exact integer sum of hundredths:
    the result does not depend on how Spark splits the partial sums."""
    centis = F.round(F.col("duration_ms") * 100).cast("bigint")
    agg = app_logs.groupBy("level", status_class("status_code").alias("status_class")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(centis).alias("_centis"))
    return agg.select("level", "status_class", "requests",
                      (F.col("_centis").cast("double") / F.col("requests") / F.lit(100.0)).alias("avg_duration_ms"))


def window_start(col: str, minutes: int) -> Column:
    """Start of the fixed ``minutes`` window containing ``col`` (epoch-aligned, zone-free)."""
    return F.expr(
        f"timestampadd(MINUTE, floor(timestampdiff(MINUTE, {EPOCH_SQL}, `{col}`) / {minutes}) * {minutes}, {EPOCH_SQL})"
    )


def _policy(policy: str, permit: int | None, window_minutes: int | None) -> tuple[int, int]:
    default_permit, default_minutes = RATE_POLICIES[policy]
    permit = default_permit if permit is None else permit
    minutes = default_minutes if window_minutes is None else window_minutes
    if permit < 0 or minutes < 1:
        raise ValueError("permit must not be negative and a window lasts at least one minute")
    return permit, minutes


def _second(col: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {EPOCH_SQL}, `{col}`)")


def _limits(b: DataFrame, permit: int) -> DataFrame:
    """A row per window of ``b`` (window_start, _ts): its ``requests`` and, if there are more than
    ``permit``, the second in which request N+1 falls (``_limit_s``) and its rank there (``_k``).
    The running sum is over the seconds of a window, each a count by then."""
    per = b.groupBy("window_start", _second("_ts").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("window_start").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    running = per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
    here = (F.col("_before") <= permit) & (F.col("_before") + F.col("_n") > permit)
    return running.groupBy("window_start").agg(
        F.sum("_n").alias("requests"),
        F.max(F.when(here, F.col("_s"))).alias("_limit_s"),
        F.max(F.when(here, F.lit(permit) + 1 - F.col("_before"))).alias("_k"),
    )


def _in_limit_second(b: DataFrame, limits: DataFrame) -> DataFrame:
    """Arrival times in the limit seconds with their counts (``_n``): equal arrivals count
    together, so a second has at most a million rows, however many requests."""
    hit = limits.where(F.col("_limit_s").isNotNull()).withColumnRenamed("window_start", "_w")
    rows = b.join(hit, (F.col("window_start") == F.col("_w")) & (_second("_ts") == F.col("_limit_s")))
    return rows.groupBy("window_start", "requests", "_k", "_ts").agg(F.count(F.lit(1)).alias("_n"))


def rate_audit(requests: DataFrame, policy: str = "login", permit: int | None = None,
               window_minutes: int | None = None, ts: str = "timestamp", tiebreak: str = "id") -> DataFrame:
    """T5: replay a fixed-window limiter over recorded requests. Per window: ``requests``,
    ``permitted``, ``rejected`` and ``first_rejected_at`` (arrival of the first request over the
    limit, the (N+1)-th by time)."""
    permit, minutes = _policy(policy, permit, window_minutes)
    b = requests.select(window_start(ts, minutes).alias("window_start"), F.col(ts).alias("_ts"))
    limits = _limits(b, permit)
    upto = F.sum("_n").over(Window.partitionBy("window_start").orderBy("_ts"))
    over = _in_limit_second(b, limits).withColumn("_upto", upto).where(F.col("_upto") >= F.col("_k"))
    over = over.groupBy("window_start", "requests").agg(F.min("_ts").alias("first_rejected_at"))
    within = limits.where(F.col("_limit_s").isNull()).select(
        "window_start", "requests", F.lit(None).cast("timestamp_ntz").alias("first_rejected_at"))
    return _audit_columns(over.unionByName(within), permit, minutes)


def _audit_columns(merged: DataFrame, permit: int, minutes: int) -> DataFrame:
    return merged.select(
        "window_start",
        F.expr(f"timestampadd(MINUTE, {minutes}, window_start)").alias("window_end"),
        "requests",
        F.least(F.col("requests"), F.lit(permit).cast("bigint")).alias("permitted"),
        F.greatest(F.col("requests") - permit, F.lit(0).cast("bigint")).alias("rejected"),
        "first_rejected_at",
    )


def permitted_requests(requests: DataFrame, policy: str = "login", ts: str = "timestamp", tiebreak: str = "id",
                       permit: int | None = None, window_minutes: int | None = None) -> DataFrame:
    """The requests a fixed-window limiter lets through (first N per window, ties by
    ``tiebreak``): those of the seconds before the one the limit falls in, and the first ones
    of that second."""
    permit, minutes = _policy(policy, permit, window_minutes)
    rows = requests.withColumn("_w", window_start(ts, minutes)).withColumn("_s", _second(ts))
    limits = _limits(rows.select(F.col("_w").alias("window_start"), F.col(ts).alias("_ts")), permit)
    placed = rows.join(limits.where(F.col("_limit_s").isNotNull()), F.col("_w") == F.col("window_start"), "left")
    before = placed.where(F.col("_limit_s").isNull() | (F.col("_s") < F.col("_limit_s")))
    # a rank below _k is at most ``permit``: the literal bound lets every task keep its first ones only
    order = Window.partitionBy("_w").orderBy(ts, tiebreak)
    at_limit = placed.where(F.col("_s") == F.col("_limit_s")).withColumn("_rn", F.row_number().over(order))
    at_limit = at_limit.where((F.col("_rn") <= permit) & (F.col("_rn") < F.col("_k")))
    return before.select(requests.columns).unionByName(at_limit.select(requests.columns))
