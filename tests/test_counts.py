"""Pages and rate audits by counts: one instant, one second, rows without a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logsmith.operators import requests as reqs
from logsmith.operators.search import log_page, newest_first
from logsmith.plans import topk
from logsmith.streaming import rate as s_rate

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
COLUMNS = ("id", "timestamp")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, timestamp timestamp_ntz").repartition(4)


def ordered(rows):
    """Newest first, rows without a time last, ids ascending with null first."""
    key = lambda r: (r[1] is None, -(r[1] - T0).total_seconds() if r[1] else 0, r[0] is not None, r[0] or "")
    return sorted(rows, key=key)


@pytest.fixture()
def small(monkeypatch):
    """Units are narrowed as if the table were large."""
    monkeypatch.setattr(topk, "SORTED_ROWS", 20)
    monkeypatch.setattr(topk, "PIVOTS", 16)


def page(df, offset, n):
    return [tuple(r) for r in topk.deep_page(df, newest_first(), offset, n).collect()]


def test_a_page_inside_one_instant(spark, small):
    rows = [(f"id{i:05}", T0) for i in range(3000)] + [(f"id{i:05}", T0 + dt.timedelta(days=1)) for i in range(3000, 3010)]
    random.Random(1).shuffle(rows)
    df, want = frame(spark, rows), ordered(rows)
    for offset, n in ((0, 15), (5, 100), (1500, 50), (2990, 50), (3009, 5), (3010, 5)):
        assert page(df, offset, n) == want[offset : offset + n], (offset, n)


def test_pages_over_days_seconds_milliseconds_nulls(spark, small):
    rng = random.Random(2)
    rows = []
    for i in range(2500):
        late = rng.choice([dt.timedelta(0), dt.timedelta(microseconds=rng.randint(0, 3)), dt.timedelta(milliseconds=rng.randint(0, 9)),
                           dt.timedelta(seconds=rng.randint(0, 50)), dt.timedelta(days=rng.randint(-30, 30))])
        rows.append((None if i % 500 == 7 else f"id{i:05}", None if i % 9 == 0 else T0 + late))
    df, want = frame(spark, rows), ordered(rows)
    for offset, n in ((0, 40), (300, 300), (1000, 7), (2200, 60), (2400, 90), (2499, 5), (2600, 1)):
        got = page(df, offset, n)
        assert got == want[offset : offset + n], (offset, n)
    only_null = frame(spark, [(f"id{i}", None) for i in range(60)])
    assert page(only_null, 30, 10) == ordered([(f"id{i}", None) for i in range(60)])[30:40]
    assert page(frame(spark, []), 0, 5) == []


def test_only_the_narrowed_rows_of_an_instant_are_sorted(spark, small):
    rows = [(f"id{i:05}", T0) for i in range(4000)]
    parts = topk._instant(frame(spark, rows), "id", 2000, 2010, 4000)
    assert parts[0].count() <= 20 + 4000 // 4 and parts[1] <= 2000


def test_log_page_is_deep_in_one_batch(spark):
    rows = [(f"id{i:05}", T0) for i in range(30_000)]
    df = frame(spark, rows)
    got = [r.id for r in log_page(df, None, page=41, page_size=500, columns=COLUMNS).collect()]
    assert got == [f"id{i:05}" for i in range(20_000, 20_500)]


def brute_audit(times, permit, minutes):
    out = {}
    for t in sorted(t for t in times):
        start = dt.datetime(1970, 1, 1) + (t - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=minutes) * dt.timedelta(minutes=minutes)
        n, first = out.get(start, (0, None))
        out[start] = n + 1, (t if n == permit else first)
    return sorted((s, n, min(n, permit), max(n - permit, 0), first) for s, (n, first) in out.items())


@pytest.mark.parametrize("permit", [0, 3, 50, 100_000])
def test_audits_of_a_burst_in_one_second(spark, permit):
    rng = random.Random(permit)
    times = [T0 + dt.timedelta(microseconds=rng.randint(0, 40)) for _ in range(600)]
    times += [T0 + dt.timedelta(seconds=rng.randint(-2000, 2000)) for _ in range(200)] + [T0] * 100
    rows = [(f"id{i:04}", t) for i, t in enumerate(times)]
    df = frame(spark, rows)
    want = brute_audit(times, permit, 15)
    cols = ("window_start", "requests", "permitted", "rejected", "first_rejected_at")
    assert sorted(tuple(r) for r in reqs.rate_audit(df, permit=permit, window_minutes=15).select(*cols).collect()) == want
    sink = None
    for k in range(3):  # three micro-batches, out of order
        part = s_rate.batch_counts(df.where(F.abs(F.xxhash64("id")) % 3 == k), permit=permit, window_minutes=15)
        sink = part if sink is None else sink.unionByName(part)
    assert sorted(tuple(r) for r in s_rate.audit(sink, permit=permit, window_minutes=15).select(*cols).collect()) == want
    assert sorted(tuple(r) for r in s_rate.counts(sink, permit=permit, window_minutes=15).select(*cols[:4]).collect()) == [w[:4] for w in want]
    let = {r.id for r in reqs.permitted_requests(df, permit=permit, window_minutes=15).collect()}
    by_window = {}
    for t, i in sorted((t, i) for i, t in rows):
        by_window.setdefault((t - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=15), []).append(i)
    assert let == {i for ids in by_window.values() for i in ids[:permit]}


def test_no_window_group_holds_the_rows_of_a_hot_second(spark):
    """20 000 requests of one second: what the ranks sort is a row per distinct arrival time."""
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"),
                                    F.expr("timestampadd(MICROSECOND, id % 7, TIMESTAMP_NTZ'2024-01-10 12:00:00')").alias("timestamp"))
    b = df.select(reqs.window_start("timestamp", 15).alias("window_start"), F.col("timestamp").alias("_ts"))
    limits = reqs._limits(b, 5)
    assert reqs._in_limit_second(b, limits).count() == 7
    assert s_rate.batch_counts(df).count() == 7
    plan = reqs.permitted_requests(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # every task keeps its first ones only
