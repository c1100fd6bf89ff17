"""Dashboard statistics (A2-A6) and facets.

The four scalars of a dashboard load are one
conditional aggregate over the 24-hour window (partial aggregation per task, a single tiny
final merge), and the top-apps list is one partial/final hash aggregate followed by a
``TakeOrderedAndProject`` top-k. Neither shuffles raw rows, so a hot app costs nothing
extra: each task ships one partial row per app.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsmith.operators.filters import conjunction, lookback

# Windows and list size of the dashboard.
STATS_HOURS = 24
RATE_HOURS = 1
RATE_MINUTES = 60.0
TOP_APPS = 10


def log_stats(df: DataFrame, as_of) -> DataFrame:
    """A2-A5: ``total_logs`` (24 h), ``error_count`` (level Error only), ``warning_count``,
    ``logs_per_minute`` (last hour / 60)."""
    recent = df.where(conjunction(lookback(df, as_of, STATS_HOURS)))
    last_hour = conjunction(lookback(df, as_of, RATE_HOURS))
    return recent.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(F.col("level") == "Error").alias("error_count"),
        F.count_if(F.col("level") == "Warning").alias("warning_count"),
        (F.count_if(last_hour) / F.lit(RATE_MINUTES)).alias("logs_per_minute"),
    )


def top_apps(df: DataFrame, as_of, limit: int = TOP_APPS) -> DataFrame:
    """Apps by log count in the last 24 h with their Error count; ties by name."""
    recent = df.where(conjunction(lookback(df, as_of, STATS_HOURS)))
    return (
        recent.groupBy("app_name")
        .agg(F.count(F.lit(1)).alias("log_count"), F.count_if(F.col("level") == "Error").alias("error_count"))
        .orderBy(F.col("log_count").desc(), F.col("app_name").asc())
        .limit(limit)
    )


def distinct_apps(df: DataFrame) -> DataFrame:
    """Sorted distinct application names."""
    return df.select("app_name").distinct().orderBy("app_name")


def distinct_environments(df: DataFrame) -> DataFrame:
    """Sorted distinct non-empty environments."""
    return df.where(F.col("environment") != "").select("environment").distinct().orderBy("environment")


def dashboard(df: DataFrame, as_of) -> DataFrame:
    """A2-A6 in ONE scan and one aggregate: ``GROUPING SETS ((app_name), ())``. The row with
    ``scope = 'total'`` carries the dashboard scalars, the ``scope = 'app'`` rows the per-app
    counts (rank them with ``top_apps_from``). The result has one row per app plus one."""
    recent = df.where(conjunction(lookback(df, as_of, STATS_HOURS)))
    last_hour = conjunction(lookback(df, as_of, RATE_HOURS))
    agg = recent.groupingSets([["app_name"], []], "app_name").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("log_count"),
        F.count_if(F.col("level") == "Error").alias("error_count"),
        F.count_if(F.col("level") == "Warning").alias("warning_count"),
        F.count_if(last_hour).alias("last_hour_count"),
    )
    return agg.select(
        F.when(F.col("_gid") == 0, F.lit("app")).otherwise(F.lit("total")).alias("scope"),
        "app_name",
        "log_count",
        "error_count",
        "warning_count",
        (F.col("last_hour_count") / F.lit(RATE_MINUTES)).alias("logs_per_minute"),
    )


def top_apps_from(dash: DataFrame, limit: int = TOP_APPS) -> DataFrame:
    """A6 from a ``dashboard`` result."""
    return (dash.where(F.col("scope") == "app").select("app_name", "log_count", "error_count")
            .orderBy(F.col("log_count").desc(), F.col("app_name").asc()).limit(limit))
