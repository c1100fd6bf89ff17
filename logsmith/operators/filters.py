"""Filters F1-F17 and argument guards E19.

A filter set becomes one ``Column`` predicate; Catalyst pushes the plain comparisons
(``level =``, ``timestamp >=``, ``status_code <=``...) into the Parquet scan. When the
frame carries the ``month`` partition column, the time bounds are also written as
``month`` bounds so whole months are pruned (a timestamp predicate alone cannot prune a
derived partition column).
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsmith.functions.text import contains_ci
from logsmith.functions.time import as_datetime, month_of, truncate_second, ts_lit
from logsmith.schema import APP_LOG_LEVELS, LEVEL_NAMES, LEVELS

# Guarded argument ranges (inclusive).
HOURS_RANGE = (1, 8760)
MIN_COUNT_RANGE = (1, 1_000_000)
LIMIT_RANGE = (1, 1000)
DAYS_RANGE = (1, 3650)
# Page defaults and the page-size clamp.
DEFAULT_PAGE = 1
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500


def guard(value: int, bounds: tuple[int, int], name: str) -> int:
    """Raise before planning when an argument is out of range."""
    lo, hi = bounds
    if value is None or not (lo <= int(value) <= hi):
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value!r}")
    return int(value)


def clamp_page(page: int | None, page_size: int | None, max_size: int = MAX_PAGE_SIZE) -> tuple[int, int]:
    """Page >= 1; size clamped to 1..``max_size`` (defaults 1 / 50 / 500)."""
    p = DEFAULT_PAGE if page is None else max(int(page), 1)
    s = DEFAULT_PAGE_SIZE if page_size is None else min(max(int(page_size), 1), max_size)
    return p, s


def canonical_level(name) -> str | None:
    """Level name (any case) or digit 0-5 -> canonical name; ``None`` when unknown."""
    if name is None:
        return None
    t = str(name).strip()
    for level, code in LEVELS:
        if t.lower() == level.lower() or t == str(code):
            return level
    return None


def split_levels(levels) -> list[str]:
    """CSV text or list -> trimmed, non-empty entries."""
    if levels is None:
        return []
    items = levels.split(",") if isinstance(levels, str) else list(levels)
    return [str(x).strip() for x in items if x is not None and str(x).strip()]


def canonical_levels(levels, strict: bool) -> list[str]:
    """canonicalise a level list. ``strict`` raises on unknown names (page path);
    otherwise unknown names are dropped (pattern path)."""
    out: list[str] = []
    for item in split_levels(levels):
        c = canonical_level(item)
        if c is None:
            if strict:
                raise ValueError(f"unknown level {item!r}; expected one of {LEVEL_NAMES}")
            continue
        if c not in out:
            out.append(c)
    return out


def _has(v) -> bool:
    return v is not None and v != ""


def time_bounds(df: DataFrame, col: str, time_from, time_to) -> list[Column]:
    """bounds at whole seconds, both inclusive; plus ``month`` bounds for pruning."""
    preds: list[Column] = []
    has_month = "month" in df.columns
    if time_from is not None:
        lo = truncate_second(time_from)
        preds.append(F.col(col) >= ts_lit(lo))
        if has_month:
            preds.append(F.col("month") >= F.lit(month_of(lo)))
    if time_to is not None:
        hi = truncate_second(time_to)
        preds.append(F.col(col) <= ts_lit(hi))
        if has_month:
            preds.append(F.col("month") <= F.lit(month_of(hi)))
    return preds


def lookback(df: DataFrame, as_of, hours: int, col: str = "timestamp") -> list[Column]:
    """``col > as_of - hours`` (strict, no upper bound) plus the month bound."""
    start = as_datetime(as_of) - dt.timedelta(hours=hours)
    preds = [F.col(col) > ts_lit(start)]
    if "month" in df.columns:
        preds.append(F.col("month") >= F.lit(month_of(start)))
    return preds


def conjunction(preds: Sequence[Column]) -> Column:
    """AND of all clauses; no clause -> TRUE."""
    return functools.reduce(operator.and_, preds, F.lit(True))


@dataclass(frozen=True)
class LogFilter:
    """the log search filter set. ``None`` / ``''`` switches a clause off."""

    level: str | None = None
    levels: str | Sequence[str] | None = None
    app_name: str | None = None
    search: str | None = None
    environment: str | None = None
    trace_id: str | None = None
    project_id: str | None = None
    exception_type: str | None = None
    source: str | None = None
    user_id: str | None = None
    request_method: str | None = None
    status_min: int | None = None
    status_max: int | None = None
    time_from: object = None
    time_to: object = None

    def predicates(self, df: DataFrame) -> list[Column]:
        preds: list[Column] = []
        if _has(self.level):
            lv = canonical_level(self.level)
            if lv is None:
                raise ValueError(f"unknown level {self.level!r}")
            preds.append(F.col("level") == lv)
        lvls = canonical_levels(self.levels, strict=True)
        if lvls:  # F8: applied together with `level` (intersection)
            preds.append(F.col("level").isin(lvls))
        for name in ("app_name", "environment", "trace_id", "project_id", "exception_type", "source", "user_id",
                     "request_method"):
            v = getattr(self, name)
            if _has(v):
                preds.append(F.col(name) == v)
        if _has(self.search):
            preds.append(contains_ci("message", self.search))
        if self.status_min is not None:
            preds.append(F.col("status_code") >= int(self.status_min))
        if self.status_max is not None:
            preds.append(F.col("status_code") <= int(self.status_max))
        preds.extend(time_bounds(df, "timestamp", self.time_from, self.time_to))
        return preds


def filter_logs(df: DataFrame, f: LogFilter | None) -> DataFrame:
    if f is None:
        return df
    preds = f.predicates(df)
    return df.where(conjunction(preds)) if preds else df


@dataclass(frozen=True)
class AppLogFilter:
    """request-log filters; ``levels`` is applied before paging."""

    level: str | None = None
    levels: str | Sequence[str] | None = None
    search: str | None = None
    time_from: object = None
    time_to: object = None

    def predicates(self, df: DataFrame) -> list[Column]:
        preds: list[Column] = []
        if _has(self.level):
            preds.append(F.col("level") == self.level)
        lvls = [x for x in split_levels(self.levels)]
        unknown = [x for x in lvls if x not in APP_LOG_LEVELS]
        if unknown:
            raise ValueError(f"unknown request-log level(s) {unknown}; expected {APP_LOG_LEVELS}")
        if lvls:
            preds.append(F.col("level").isin(lvls))
        if _has(self.search):
            preds.append(contains_ci("message", self.search))
        preds.extend(time_bounds(df, "timestamp", self.time_from, self.time_to))
        return preds


def filter_app_logs(df: DataFrame, f: AppLogFilter | None) -> DataFrame:
    if f is None:
        return df
    preds = f.predicates(df)
    return df.where(conjunction(preds)) if preds else df


# Request paths of static files are not request-logged.
STATIC_PATH_REGEX = "^/(css|js|lib|images|favicon)"


def exclude_static(df: DataFrame, col: str = "request_path") -> DataFrame:
    """F16: drop requests for static files (a request without a path is none)."""
    return df.where(~F.coalesce(F.col(col).rlike(STATIC_PATH_REGEX), F.lit(False)))


def trace_only(df: DataFrame, trace_id: str) -> DataFrame:
    """rows of one trace; an empty id selects nothing."""
    if not trace_id:
        return df.where(F.lit(False))
    return df.where(F.col("trace_id") == trace_id)
