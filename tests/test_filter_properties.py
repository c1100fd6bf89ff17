"""Property test: the filter set (F1-F9) against a plain-Python brute force on the sf0.001
logs view (100 rows, collected once)."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from logsmith.operators.filters import LogFilter, filter_logs
from logsmith.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
LEVELS = ["Trace", "Debug", "Info", "Warning", "Error", "Fatal"]


@pytest.fixture(scope="module")
def data(spark):
    df = fx.logs(spark, SF).cache()
    return df, [r.asDict() for r in df.collect()]


def brute(rows, f: LogFilter):
    out = []
    for r in rows:
        if f.level and r["level"] != f.level:
            continue
        if f.levels and r["level"] not in [x.strip() for x in f.levels.split(",")]:
            continue
        if f.app_name and r["app_name"] != f.app_name:
            continue
        if f.environment and r["environment"] != f.environment:
            continue
        if f.request_method and r["request_method"] != f.request_method:
            continue
        if f.search and f.search.lower() not in r["message"].lower():
            continue
        if f.status_min is not None and r["status_code"] < f.status_min:
            continue
        if f.status_max is not None and r["status_code"] > f.status_max:
            continue
        if f.time_from is not None and r["timestamp"] < f.time_from.replace(microsecond=0):
            continue
        if f.time_to is not None and r["timestamp"] > f.time_to.replace(microsecond=0):
            continue
        out.append(r["id"])
    return sorted(out)


maybe = lambda s: st.one_of(st.none(), s)
times = st.datetimes(min_value=dt.datetime(2023, 12, 31), max_value=dt.datetime(2024, 2, 1))


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    level=maybe(st.sampled_from(LEVELS)),
    levels=maybe(st.lists(st.sampled_from(LEVELS), min_size=1, max_size=3).map(",".join)),
    app=maybe(st.sampled_from([f"svc-{i}" for i in range(12)])),
    env=maybe(st.sampled_from(["production", "staging", "development"])),
    method=maybe(st.sampled_from(["GET", "POST", "PUT", "DELETE"])),
    search=maybe(st.sampled_from(["order", "USER", "100%_ok", "ı", "click", "zzz"])),
    smin=maybe(st.integers(0, 600)),
    smax=maybe(st.integers(0, 600)),
    t1=maybe(times),
    t2=maybe(times),
)
def test_filters_match_brute_force(data, level, levels, app, env, method, search, smin, smax, t1, t2):
    df, rows = data
    f = LogFilter(level=level, levels=levels, app_name=app, environment=env, request_method=method, search=search,
                  status_min=smin, status_max=smax, time_from=t1, time_to=t2)
    got = sorted(r.id for r in filter_logs(df, f).select("id").collect())
    assert got == brute(rows, f)
