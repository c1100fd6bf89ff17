"""Search: filtered count (A1), page envelope (A11), log page (K3/K4), request-log page
(K5/A12) and keyset paging for deep pages.

A page is ``orderBy(timestamp desc, id).offset(o).limit(n)`` with a first level that keeps the
top ``o+n`` rows of groups of input tasks (``plans.topk``: no full sort, no shuffle of the
table, a bounded final merge). Deep pages are found by counts per day and second;
``log_page_after`` offers keyset paging on ``(timestamp, id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsmith.functions.time import ts_lit
from logsmith.operators.filters import MAX_PAGE_SIZE, AppLogFilter, LogFilter, clamp_page, filter_app_logs, filter_logs
from logsmith.plans.topk import ordered_page
from logsmith.schema import APP_LOG_PAGE_COLUMNS, LOG_PAGE_COLUMNS


def newest_first():
    """Newest first; ``id`` breaks timestamp ties (a whole ingest batch shares one stamp)."""
    return F.col("timestamp").desc(), F.col("id").asc()


def log_count(df: DataFrame, f: LogFilter | None = None, page_size: int | None = None) -> DataFrame:
    """A1 + A11: one row ``total_count, page_size, total_pages``."""
    _, size = clamp_page(1, page_size)
    total = F.count(F.lit(1))
    return filter_logs(df, f).agg(
        total.alias("total_count"),
        F.lit(size).alias("page_size"),
        F.ceil(total / F.lit(float(size))).cast("int").alias("total_pages"),
    )


def log_page(df: DataFrame, f: LogFilter | None = None, page: int | None = 1, page_size: int | None = 50,
             columns=LOG_PAGE_COLUMNS, max_size: int = MAX_PAGE_SIZE) -> DataFrame:
    """K3/K4: one page, newest first (ties broken by ``id``); a page size over ``max_size`` is
    cut to it."""
    p, size = clamp_page(page, page_size, max_size)
    return ordered_page(filter_logs(df, f).select(*columns), newest_first(), (p - 1) * size, size)


def log_page_after(df: DataFrame, f: LogFilter | None, after_ts, after_id: str, page_size: int | None = 50,
                   columns=LOG_PAGE_COLUMNS) -> DataFrame:
    """Keyset page: rows strictly after ``(after_ts, after_id)`` in newest-first order."""
    _, size = clamp_page(1, page_size)
    t = ts_lit(after_ts)
    after = (F.col("timestamp") < t) | ((F.col("timestamp") == t) & (F.col("id") > after_id))
    return ordered_page(filter_logs(df, f).where(after).select(*columns), newest_first(), 0, size)


def app_log_count(df: DataFrame, f: AppLogFilter | None = None, page_size: int | None = None) -> DataFrame:
    """A12 + A11 on the request log."""
    _, size = clamp_page(1, page_size)
    total = F.count(F.lit(1))
    return filter_app_logs(df, f).agg(
        total.alias("total_count"),
        F.lit(size).alias("page_size"),
        F.ceil(total / F.lit(float(size))).cast("int").alias("total_pages"),
    )


def app_log_page(df: DataFrame, f: AppLogFilter | None = None, page: int | None = 1, page_size: int | None = 50,
                 columns=APP_LOG_PAGE_COLUMNS) -> DataFrame:
    """K5: request-log page; multi-level filtering happens before paging."""
    p, size = clamp_page(page, page_size)
    return ordered_page(filter_app_logs(df, f).select(*columns), newest_first(), (p - 1) * size, size)
