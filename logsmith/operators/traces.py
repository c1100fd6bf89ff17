"""Distributed traces: timeline with offsets (W1), the 500-entry cap (W2) and the per-trace
summary (A10), computed for one trace or for all traces at once.

Timelines of all traces:

1. drop the empty trace id (it would be one giant key and means "no trace");
2. the first ``cap + 1`` entries per ``(trace_id, input task % B)``, then per trace. Spark plans
   each ``row_number() <= k`` as a map-side ``WindowGroupLimit`` before its shuffle, so a task
   sends at most ``cap + 1`` rows of any trace, a first-level reducer sees ``cap x tasks / B`` of
   them and the final one ``cap x B``: a hot trace never reaches a task in full. The result is
   exact, and the bucket (the input task) is reproduced by a re-run task;
3. offsets (a window min) reuse the ``trace_id`` partitioning, and ``truncated`` tells that the
   trace has more than ``cap`` entries.

Spark inserts the map-side limit up to ``spark.sql.optimizer.windowGroupLimitThreshold``
(default 1000); a larger cap is refused. Summaries need no entries: they are two algebraic
aggregates, per (trace, app) and per trace, over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsmith.functions.levels import level_code
from logsmith.operators.filters import conjunction, time_bounds, trace_only
from logsmith.plans.topk import by_input_task, group_limit_threshold
from logsmith.schema import TRACE_COLUMNS

# Entries kept per trace; Error and Fatal count as errors in a trace.
TRACE_CAP = 500
ERROR_CODE = 4

_ORDER = ("timestamp", "id")


def _offset_ms(partition_col: str = "trace_id"):
    first = F.min("timestamp").over(Window.partitionBy(partition_col))
    return F.timestamp_diff("MICROSECOND", first, F.col("timestamp")).cast("double") / F.lit(1000.0)


# First-level groups of a trace.
TRACE_BUCKETS = 16


def capped_traces(df: DataFrame, cap: int = TRACE_CAP, buckets: int = TRACE_BUCKETS) -> DataFrame:
    """W2 for every trace: the first ``cap`` entries by ``(timestamp, id)`` with ``entry_no`` and
    ``truncated`` (the trace has more)."""
    if not 0 < cap < group_limit_threshold(df):
        raise ValueError(f"cap must be from 1 to {group_limit_threshold(df) - 1}")
    level1 = Window.partitionBy("trace_id", "_bucket").orderBy(*_ORDER)
    base = (
        df.where(F.col("trace_id") != "")
        .withColumn("_bucket", by_input_task(buckets))
        .withColumn("_rn", F.row_number().over(level1))
        .where(F.col("_rn") <= cap + 1)
        .drop("_rn", "_bucket")
    )
    per_trace = Window.partitionBy("trace_id").orderBy(*_ORDER)
    first = base.withColumn("entry_no", F.row_number().over(per_trace)).where(F.col("entry_no") <= cap + 1)
    more = F.max("entry_no").over(Window.partitionBy("trace_id")) > cap
    return first.withColumn("truncated", more).where(F.col("entry_no") <= cap)


def trace_timelines(df: DataFrame, cap: int = TRACE_CAP, buckets: int = TRACE_BUCKETS) -> DataFrame:
    """W1 + W2 for all traces: trace projection + ``entry_no``, ``offset_ms``, ``truncated``."""
    capped = capped_traces(df.select("trace_id", *TRACE_COLUMNS), cap, buckets)
    return capped.select("trace_id", *TRACE_COLUMNS, "entry_no", _offset_ms().alias("offset_ms"), "truncated")


def trace_timeline(df: DataFrame, trace_id: str, cap: int = TRACE_CAP, time_from=None, time_to=None) -> DataFrame:
    """F17 + P3 + W1 + W2 for one trace; time bounds (inclusive seconds) spare the months outside
    them."""
    rows = trace_only(df, trace_id).where(conjunction(time_bounds(df, "timestamp", time_from, time_to)))
    return trace_timelines(rows, cap)


def trace_summaries(df: DataFrame) -> DataFrame:
    """A10 for every trace, over all of its entries: bounds, duration, services in first-seen
    order, error flag."""
    rows = df.where(F.col("trace_id") != "")
    per_app = rows.groupBy("trace_id", "app_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("timestamp", "id")).alias("first"),
        F.max("timestamp").alias("last_ts"),
        F.bool_or(level_code("level") >= ERROR_CODE).alias("bad"),
    )
    first_ts, last_ts = F.min("first.timestamp"), F.max("last_ts")
    services = F.transform(F.array_sort(F.collect_list(F.struct("first", "app_name"))), lambda s: s["app_name"])
    return per_app.groupBy("trace_id").agg(
        F.sum("n").alias("entry_count"),
        first_ts.alias("first_ts"),
        last_ts.alias("last_ts"),
        (F.timestamp_diff("MICROSECOND", first_ts, last_ts).cast("double") / F.lit(1000.0)).alias("total_duration_ms"),
        F.array_join(services, ",").alias("services"),
        F.size(services).alias("service_count"),
        F.bool_or("bad").alias("has_errors"),
    )


def trace_summary(df: DataFrame, trace_id: str) -> DataFrame:
    """A10 for one trace."""
    return trace_summaries(trace_only(df, trace_id))
