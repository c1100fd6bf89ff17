"""Dashboard figures from a maintained rollup (A2-A6): additive counts per (minute, app, level);
and recurring patterns (A7) from counts per (hour, pattern, level, app).

Every append to the log table adds the counts of its own rows to the rollup table, under the same
step, so that a repeated batch counts once in both. A look-back sums whole minutes from the
rollup; the minute that its start falls into is counted from the log rows of that minute alone,
so the figures equal those of a scan of the logs, to the microsecond. The rollup of a batch is
committed after its rows: a reader between the two commits sees the figures of the batch before.
Deletes by age go to both tables (``delete_older_than``); a look-back that starts at or after the
deletion's cutoff is exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsmith.functions.text import pattern_mask
from logsmith.functions.time import EPOCH_SQL, as_datetime, to_minute, truncate_minute, ts_lit
from logsmith.operators.filters import HOURS_RANGE, LIMIT_RANGE, MIN_COUNT_RANGE, canonical_levels, guard
from logsmith.operators.patterns import DEFAULT_HOURS, DEFAULT_LIMIT, DEFAULT_MIN_COUNT
from logsmith.operators.stats import RATE_HOURS, RATE_MINUTES, STATS_HOURS, TOP_APPS
from logsmith.sources.manifest import ManifestTable

ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("minute", T.TimestampNTZType()),
        T.StructField("app_name", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("logs", T.LongType()),
    ]
)


def rollup_table(spark: SparkSession, path: str) -> ManifestTable:
    return ManifestTable(spark, path, ROLLUP_SCHEMA, ts="minute", inserted="minute", cluster=("minute", "app_name"))


def minute_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy(to_minute("timestamp").alias("minute"), "app_name", "level").agg(F.count(F.lit(1)).alias("logs"))


PATTERN_SCHEMA = T.StructType(
    [
        T.StructField("hour", T.TimestampNTZType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("app_name", T.StringType()),
        T.StructField("cnt", T.LongType()),
        T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("sample_message", T.StringType()),
        T.StructField("last_seen", T.TimestampNTZType()),
    ]
)
PATTERN_KEYS = ("pattern", "level", "app_name")


def pattern_table(spark: SparkSession, path: str) -> ManifestTable:
    return ManifestTable(spark, path, PATTERN_SCHEMA, ts="hour", inserted="hour", cluster=("hour", "app_name"))


def _hour(col: str) -> Column:
    return F.expr(f"timestampadd(HOUR, floor(timestampdiff(SECOND, {EPOCH_SQL}, `{col}`) / 3600), {EPOCH_SQL})")


def _patterns_seen() -> list[Column]:
    """Additive: the first time with its smallest message is the least of such pairs."""
    return [
        F.sum("cnt").alias("cnt"),
        F.min(F.struct("first_seen", "sample_message")).alias("_first"),
        F.max("last_seen").alias("last_seen"),
    ]


def _single(logs: DataFrame) -> DataFrame:
    return logs.select(
        _hour("timestamp").alias("hour"), pattern_mask("message").alias("pattern"), "level", "app_name",
        F.lit(1).cast("bigint").alias("cnt"), F.col("timestamp").alias("first_seen"),
        F.col("message").alias("sample_message"), F.col("timestamp").alias("last_seen"))


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(*_patterns_seen()).select(*keys, "cnt", "_first.*", "last_seen")


def pattern_counts(logs: DataFrame) -> DataFrame:
    return _summed(_single(logs), "hour", *PATTERN_KEYS)


def append_with_rollup(logs: ManifestTable, rollup: ManifestTable, rows: DataFrame, step: tuple[str, int],
                       patterns: ManifestTable | None = None) -> None:
    """Append rows and their counts. If the job dies in between, the same step again adds what is
    missing and nothing twice."""
    logs.append(rows, step)
    rollup.append(minute_counts(rows), step)
    if patterns is not None:
        patterns.append(pattern_counts(rows), step)


def fold(rollup: ManifestTable) -> int:
    """Sum the counts that many appends left for one minute (or hour) into one row each."""

    def change(read):
        if len(read.files) < 2:
            return read.version
        rows = rollup.scan(list(read.files))
        if rollup.schema == PATTERN_SCHEMA:
            whole = _summed(rows, "hour", *PATTERN_KEYS)
        else:
            whole = rows.groupBy("minute", "app_name", "level").agg(F.sum("logs").alias("logs"))
        return rollup.commit(read, rollup.write_files(whole, 1), list(read.files))

    return rollup._repeated(change)


def log_patterns(logs: ManifestTable, patterns: ManifestTable, as_of, hours: int = DEFAULT_HOURS,
                 min_count: int = DEFAULT_MIN_COUNT, limit: int = DEFAULT_LIMIT, levels=None, app_name: str | None = None) -> DataFrame:
    """A7 as ``patterns.log_patterns`` has it: whole hours from the counts, the hour that the
    look-back starts in from its log rows."""
    start = as_datetime(as_of) - dt.timedelta(hours=guard(hours, HOURS_RANGE, "hours"))
    min_count, limit = guard(min_count, MIN_COUNT_RANGE, "min_count"), guard(limit, LIMIT_RANGE, "limit")
    edge = start.replace(minute=0, second=0, microsecond=0)
    end = edge + dt.timedelta(hours=1)
    whole = patterns.read(time_from=edge).where(F.col("hour") > ts_lit(edge)).drop("month")
    rest = logs.read(time_from=start, time_to=end).where((F.col("timestamp") > ts_lit(start)) & (F.col("timestamp") < ts_lit(end)))
    counted = whole.unionByName(_single(rest))
    if wanted := canonical_levels(levels, strict=False):
        counted = counted.where(F.col("level").isin(wanted))
    if app_name:
        counted = counted.where(F.col("app_name") == app_name)
    top = _summed(counted, *PATTERN_KEYS).where(F.col("cnt") >= min_count)
    top = top.orderBy(F.col("cnt").desc(), *PATTERN_KEYS).limit(limit)
    return top.select("pattern", "cnt", "level", "app_name", "first_seen", "last_seen", "sample_message")


def _counted(logs: ManifestTable, rollup: ManifestTable, as_of) -> DataFrame:
    """``app_name, level, day, hour``: additive counts of the last 24 hours and of the last hour."""
    day, hour = (as_datetime(as_of) - dt.timedelta(hours=h) for h in (STATS_HOURS, RATE_HOURS))
    edge = lambda t: truncate_minute(t)
    minutes = rollup.read(time_from=edge(day)).where(F.col("minute") > ts_lit(edge(day)))
    whole = minutes.select("app_name", "level", F.col("logs").alias("day"),
                           F.when(F.col("minute") > ts_lit(edge(hour)), F.col("logs")).otherwise(0).alias("hour"))

    def rest(start: dt.datetime, day: int, hour: int) -> DataFrame:
        """Log rows of the minute of ``start`` that come after it."""
        end = edge(start) + dt.timedelta(minutes=1)
        here = logs.read(time_from=start, time_to=end).where((F.col("timestamp") > ts_lit(start)) & (F.col("timestamp") < ts_lit(end)))
        here = here.where(F.col("month").isin([start.year * 100 + start.month, end.year * 100 + end.month]))
        return here.select("app_name", "level", F.lit(day).cast("bigint").alias("day"), F.lit(hour).cast("bigint").alias("hour"))

    return whole.unionByName(rest(day, 1, 0)).unionByName(rest(hour, 0, 1))


def log_stats(logs: ManifestTable, rollup: ManifestTable, as_of) -> DataFrame:
    """A2-A5 as ``stats.log_stats`` has them."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    of = lambda level: F.when(F.col("level") == level, F.col("day")).otherwise(0)
    return _counted(logs, rollup, as_of).agg(
        total("day").alias("total_logs"),
        total(of("Error")).alias("error_count"),
        total(of("Warning")).alias("warning_count"),
        (total("hour") / F.lit(RATE_MINUTES)).alias("logs_per_minute"),
    )


def top_apps(logs: ManifestTable, rollup: ManifestTable, as_of, limit: int = TOP_APPS) -> DataFrame:
    """A6 as ``stats.top_apps`` has it."""
    per = _counted(logs, rollup, as_of).where("day > 0").groupBy("app_name").agg(
        F.sum("day").alias("log_count"),
        F.coalesce(F.sum(F.when(F.col("level") == "Error", F.col("day"))), F.lit(0)).cast("bigint").alias("error_count"))
    return per.orderBy(F.col("log_count").desc(), F.col("app_name").asc()).limit(limit)
