"""Traces: a short timeline, the 500 cap, and a hot trace."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logsmith.operators import traces

BASE = dt.datetime(2024, 1, 15, 10, 0, 0)
STEPS = [
    (0, "edge", "Info"), (12, "cart", "Trace"), (31, "cart", "Info"), (75, "stock", "Debug"),
    (140, "cart", "Warning"), (333, "mailer", "Error"), (990, "edge", "Info"),
]
COLS = "id string, timestamp timestamp_ntz, level string, app_name string, message string, metadata string, " \
       "exception_type string, source string, trace_id string"


def rows(entries, trace="walk-1"):
    return [(f"{trace}-{i:05d}", BASE + dt.timedelta(milliseconds=ms), lvl, app, f"m{i}", "{}", "", "", trace)
            for i, (ms, app, lvl) in enumerate(entries)]


def test_golden_timeline(spark):
    df = spark.createDataFrame(rows(STEPS), COLS)
    tl = traces.trace_timeline(df, "walk-1").orderBy("entry_no").collect()
    assert [r.offset_ms for r in tl] == [0, 12, 31, 75, 140, 333, 990]
    s = traces.trace_summary(df, "walk-1").first()
    assert s.total_duration_ms == 990.0 and s.entry_count == 7 and s.has_errors
    assert s.services == "edge,cart,stock,mailer" and s.service_count == 4
    assert traces.trace_timeline(df, "").count() == 0


def test_fatal_counts_as_error_warning_does_not(spark):
    df = spark.createDataFrame(rows([(0, "a", "Fatal")], "t1") + rows([(0, "a", "Warning")], "t2"), COLS)
    got = {r.trace_id: r.has_errors for r in traces.trace_summaries(df).collect()}
    assert got == {"t1": True, "t2": False}


def test_cap_501(spark):
    entries = [(i, f"svc-{i % 3}", "Info") for i in range(501)]
    df = spark.createDataFrame(rows(entries, "big"), COLS)
    for salt in (1, 4):
        tl = traces.trace_timelines(df.repartition(4), buckets=salt)
        assert tl.count() == 500
        assert tl.agg(F.max("offset_ms")).first()[0] == 499.0
        assert {r.truncated for r in tl.collect()} == {True}
    assert not traces.trace_timelines(df, cap=501).where("truncated").count()
    for cap in (0, 1000):
        with pytest.raises(ValueError):
            traces.trace_timelines(df, cap=cap)
    s = traces.trace_summaries(df).first()  # a summary sees every entry
    assert s.entry_count == 501 and s.total_duration_ms == 500.0
    assert s.services == "svc-0,svc-1,svc-2"


def test_hot_trace_equals_brute_force(spark):
    # one trace holds most rows, with timestamp ties broken by id
    hot = [(i // 3, f"svc-{i % 7}", "Error" if i == 1500 else "Info") for i in range(3000)]
    small = [(i, "x", "Info") for i in range(5)]
    data = rows(hot, "hot") + rows(small, "cold") + [("empty-1", BASE, "Info", "a", "m", "{}", "", "", "")]
    df = spark.createDataFrame(data, COLS).repartition(6)
    got = {(r.trace_id, r.id, r.entry_no, r.offset_ms) for r in traces.trace_timelines(df, cap=500).collect()}
    tree = {(r.trace_id, r.id, r.entry_no, r.offset_ms) for r in traces.trace_timelines(df, cap=500, buckets=4).collect()}
    assert tree == got
    expect = set()
    by_trace = {}
    for r in data:
        if r[8]:
            by_trace.setdefault(r[8], []).append(r)
    for t, rs in by_trace.items():
        rs.sort(key=lambda r: (r[1], r[0]))
        first = rs[0][1]
        for n, r in enumerate(rs[:500], 1):
            expect.add((t, r[0], n, (r[1] - first) / dt.timedelta(milliseconds=1)))
    assert got == expect
    s = {r.trace_id: r for r in traces.trace_summaries(df).collect()}
    assert set(s) == {"hot", "cold"} and s["hot"].entry_count == 3000 and s["hot"].has_errors


def test_offsets_are_wall_clock_in_any_session_zone(spark):
    # 2024-03-10 02:00-03:00 does not exist in America/Los_Angeles; NTZ arithmetic must not care
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        t1, t2 = dt.datetime(2024, 3, 10, 1, 59, 59), dt.datetime(2024, 3, 10, 3, 0, 1)
        data = [("a", t1, "Info", "x", "m", "{}", "", "", "dst"), ("b", t2, "Error", "y", "m", "{}", "", "", "dst")]
        df = spark.createDataFrame(data, COLS)
        offs = [r.offset_ms for r in traces.trace_timeline(df, "dst").orderBy("entry_no").collect()]
        assert offs == [0.0, 3602000.0]
        assert traces.trace_summary(df, "dst").first().total_duration_ms == 3602000.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
