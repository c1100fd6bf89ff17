"""Search edge cases: literal wildcards, second-granular bounds, paging and keyset paging."""

import datetime as dt

from logsmith.operators import search, stats, patterns
from logsmith.operators.filters import LogFilter, AppLogFilter, filter_app_logs
from logsmith.schema import LOGS_SCHEMA

import pytest

B = dt.datetime(2024, 1, 30, 10, 0, 0)


def logs(spark, rows):
    full = []
    for i, (ts, level, app, msg) in enumerate(rows):
        full.append((f"{i:04d}", ts, level, app, msg, "{}", "", "", "", "", "GET", "/", 200, 1.0, "u", "", "", "h",
                     "production", None, "", ts))
    return spark.createDataFrame(full, LOGS_SCHEMA)


def test_literal_search_wildcards(spark):
    df = logs(spark, [(B, "Info", "a", "paid 100%_OK"), (B, "Info", "a", "paid 100xxok"), (B, "Info", "a", "PAID 100%_ok!")])
    got = sorted(r.id for r in search.filter_logs(df, LogFilter(search="100%_ok")).collect())
    assert got == ["0000", "0002"]


def test_upper_bound_is_whole_second(spark):
    df = logs(spark, [(B.replace(second=59), "Info", "a", "x"), (B.replace(second=59, microsecond=500000), "Info", "a", "x"),
                      (B.replace(second=30), "Info", "a", "x"), (B.replace(second=29, microsecond=999000), "Info", "a", "x")])
    f = LogFilter(time_from=B.replace(second=30, microsecond=750000), time_to=B.replace(second=59, microsecond=999000))
    assert sorted(r.id for r in search.filter_logs(df, f).collect()) == ["0000", "0002"]


def test_level_and_levels_intersect(spark):
    df = logs(spark, [(B, "Error", "a", "x"), (B, "Fatal", "a", "x"), (B, "Info", "a", "x")])
    assert [r.id for r in search.filter_logs(df, LogFilter(level="4", levels="Error,Fatal")).collect()] == ["0000"]
    with pytest.raises(ValueError):
        search.filter_logs(df, LogFilter(levels="Error,nope"))


def test_paging_clamp_and_keyset(spark):
    rows = [(B + dt.timedelta(seconds=i // 2), "Info", "a", "x") for i in range(25)]  # ties on every second
    df = logs(spark, rows)
    assert search.log_page(df, None, page=0, page_size=0).count() == 1
    assert search.log_page(df, None, page=1, page_size=999).count() == 25
    pages = [[r.id for r in search.log_page(df, None, page=p, page_size=10).collect()] for p in (1, 2, 3)]
    assert [len(p) for p in pages] == [10, 10, 5]
    flat = [i for p in pages for i in p]
    assert len(set(flat)) == 25
    last = search.log_page(df, None, page=1, page_size=10).collect()[-1]
    after = [r.id for r in search.log_page_after(df, None, last.timestamp, last.id, page_size=10).collect()]
    assert after == pages[1]
    c = search.log_count(df, LogFilter(app_name="a"), page_size=10).first()
    assert (c.total_count, c.page_size, c.total_pages) == (25, 10, 3)


def test_stats_window_strict_and_error_only(spark):
    as_of = dt.datetime(2024, 1, 31)
    rows = [(as_of - dt.timedelta(hours=24), "Error", "a", "x"),  # exactly 24 h old: excluded (strict)
            (as_of - dt.timedelta(hours=23), "Error", "a", "x"),
            (as_of - dt.timedelta(minutes=30), "Fatal", "b", "x"),
            (as_of + dt.timedelta(hours=1), "Warning", "b", "x")]  # no upper bound
    df = logs(spark, rows)
    s = stats.log_stats(df, as_of).first()
    assert (s.total_logs, s.error_count, s.warning_count) == (3, 1, 1)
    assert s.logs_per_minute == 2 / 60.0
    top = [(r.app_name, r.log_count, r.error_count) for r in stats.top_apps(df, as_of).collect()]
    assert top == [("b", 2, 0), ("a", 1, 1)]


def test_patterns_guards(spark):
    df = logs(spark, [(B, "Info", "a", "x")])
    for kw in ({"hours": 0}, {"min_count": 0}, {"limit": 1001}):
        with pytest.raises(ValueError):
            patterns.log_patterns(df, B, **kw)


def test_app_log_levels_before_paging(spark):
    from logsmith.schema import APP_LOGS_SCHEMA
    rows = [(str(i), B + dt.timedelta(seconds=i), ["Information", "Warning", "Error"][i % 3], "HTTP", f"GET /x -> {i}",
             None, "GET", "/x", 200, 1.0, B) for i in range(30)]
    df = spark.createDataFrame(rows, APP_LOGS_SCHEMA)
    page = search.app_log_page(df, AppLogFilter(levels="Warning,Error"), page=1, page_size=50).collect()
    assert len(page) == 20 and {r.level for r in page} == {"Warning", "Error"}
    with pytest.raises(ValueError):
        filter_app_logs(df, AppLogFilter(levels="Info"))


def test_rate_audit_and_permitted_requests(spark):
    from logsmith.operators import requests as reqs
    base = dt.datetime(2024, 1, 30, 10, 0, 0)
    # 8 requests in the first 15-minute window (two share a timestamp), 2 in the next
    ts = [base + dt.timedelta(seconds=s) for s in (1, 2, 2, 3, 4, 5, 6, 7)] + [base + dt.timedelta(minutes=20)] * 2
    df = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(ts)], "id string, timestamp timestamp_ntz")
    audit = {r.window_start: r for r in reqs.rate_audit(df, "login").collect()}
    w0 = audit[base]
    assert (w0.requests, w0.permitted, w0.rejected, w0.first_rejected_at) == (8, 5, 3, base + dt.timedelta(seconds=5))
    w1 = audit[base + dt.timedelta(minutes=15)]
    assert (w1.requests, w1.permitted, w1.rejected, w1.first_rejected_at) == (2, 2, 0, None)
    assert w0.window_end == base + dt.timedelta(minutes=15)
    allowed = sorted(r.id for r in reqs.permitted_requests(df, "login").collect())
    assert allowed == ["00", "01", "02", "03", "04", "08", "09"]
