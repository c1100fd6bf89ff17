"""Recurring-message pattern mining (E1 + A7).

``groupBy(pattern, level, app_name)`` with count / min / max of fixed-width values is a hash
aggregate that combines map-side, so a hot pattern (one message repeated by a third of all
rows) ships one partial row per task. HAVING and the top-k are a filter and a
``TakeOrderedAndProject``. The sample message is then fetched for the winners only (at most
``limit`` <= 1000 rows, broadcast): the smallest message among their first-seen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsmith.functions.text import PATTERN_PREFIX_CHARS, pattern_mask
from logsmith.operators.filters import (
    HOURS_RANGE,
    LIMIT_RANGE,
    MIN_COUNT_RANGE,
    canonical_level,
    canonical_levels,
    conjunction,
    guard,
    lookback,
)

# Defaults of the pattern query.
DEFAULT_HOURS = 24
DEFAULT_MIN_COUNT = 2
DEFAULT_LIMIT = 50


def log_patterns(df: DataFrame, as_of, hours: int = DEFAULT_HOURS, level: str | None = None, levels=None,
                 app_name: str | None = None, min_count: int = DEFAULT_MIN_COUNT,
                 limit: int = DEFAULT_LIMIT, prefix_chars: int | None = PATTERN_PREFIX_CHARS) -> DataFrame:
    """Top recurring patterns: ``pattern, cnt, level, app_name, first_seen, last_seen,
    sample_message`` ordered by count (ties: pattern, level, app_name). A pattern is taken from
    the first ``prefix_chars`` characters of a message (``None``: from all of it)."""
    hours = guard(hours, HOURS_RANGE, "hours")
    min_count = guard(min_count, MIN_COUNT_RANGE, "min_count")
    limit = guard(limit, LIMIT_RANGE, "limit")
    preds = lookback(df, as_of, hours)
    if level:
        lv = canonical_level(level)
        if lv is None:
            raise ValueError(f"unknown level {level!r}")
        preds.append(F.col("level") == lv)
    lvls = canonical_levels(levels, strict=False)  # unknown names dropped
    if lvls:
        preds.append(F.col("level").isin(lvls))
    if app_name:
        preds.append(F.col("app_name") == app_name)
    keys = ["pattern", "level", "app_name"]
    rows = df.where(conjunction(preds)).select(pattern_mask("message", prefix_chars).alias("pattern"), "level", "app_name", "timestamp", "message")
    order = [F.col("cnt").desc(), *keys]
    winners = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        .where(F.col("cnt") >= min_count)
        .orderBy(*order)
        .limit(limit)
    )
    named = F.broadcast(winners.select(*(F.col(k).alias(f"_{k}") for k in keys), "cnt", "first_seen", "last_seen"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("timestamp") == F.col("first_seen")]
    met = rows.join(named, conjunction(same)).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("message")))
    return met.where(F.col("_n") == 1).orderBy(*order).select(
        "pattern", "cnt", "level", "app_name", "first_seen", "last_seen", F.col("message").alias("sample_message"))
