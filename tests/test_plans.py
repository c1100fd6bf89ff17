"""Physical-plan checks: pushdown, partition pruning, broadcast, top-k, map-side limits,
no Python evaluation anywhere."""

import datetime as dt

import pytest

from logsmith import registry
from logsmith.operators import requests as reqs
from logsmith.operators import search, stats, traces
from logsmith.operators.filters import LogFilter
from logsmith.operators.search import newest_first
from logsmith.plans.inspect import plan_text
from logsmith.plans.topk import ordered_page
from logsmith.sources import fixtures as fx
from logsmith.sources.sinks import read_logs, write_logs

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def stored(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/logs"
    write_logs(fx.logs(spark, SF), path, rewrite=True)
    return read_logs(spark, path)


def test_stored_scan_prunes_and_pushes(spark, stored):
    f = LogFilter(level="Error", time_from="2024-01-20 00:00:00", time_to="2024-01-25 00:00:00")
    p = plan_text(search.log_page(stored, f))
    assert "TakeOrderedAndProject" in p
    assert "PartitionFilters: [isnotnull(month" in p and "month#" in p
    assert "PushedFilters: [" in p and "GreaterThanOrEqual(timestamp" in p and "EqualTo(level,Error)" in p


def test_stats_column_pruning(spark, stored):
    p = plan_text(stats.top_apps(stored, AS_OF))
    read_schema = [ln for ln in p.splitlines() if "ReadSchema" in ln][0]
    assert "message" not in read_schema and "app_name" in read_schema


def test_trace_cap_is_map_side_limited(spark):
    p = plan_text(traces.trace_timelines(fx.logs(spark, SF)))
    assert p.count("WindowGroupLimit") >= 4 and "spark_partition_id" in p.lower()


def test_no_python_in_any_registered_plan(spark):
    for name, q in registry.QUERIES.items():
        p = plan_text(q(spark, SF))
        assert not any(x in p for x in ("PythonUDF", "EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")), name


def test_no_exchange_without_a_key(spark):
    for name in ("top_apps", "log_stats", "log_search_literal", "request_log"):
        assert "RoundRobin" not in plan_text(registry.QUERIES[name](spark, SF)), name


def test_patterns_aggregate_by_hash(spark):
    p = plan_text(registry.QUERIES["log_patterns"](spark, SF))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_empty_trace_ids_stay_out_of_the_join(spark):
    p = plan_text(registry.QUERIES["error_trace_logs"](spark, SF))
    joins = p[: p.index("Scan parquet")] if "Scan parquet" in p else p
    assert joins and p.count("Filter") >= 2


def test_page_is_a_tree_and_equals_brute_force(spark):
    df = fx.logs(spark, SF).repartition(6)
    rows = sorted(df.collect(), key=lambda r: (-r.timestamp.timestamp(), r.id))
    page = ordered_page(df, newest_first(), 7, 20)
    assert [r.id for r in page.collect()] == [r.id for r in rows[7:27]]
    assert "WindowGroupLimit" in plan_text(page) and "TakeOrderedAndProject" in plan_text(page)


def test_deep_pages_sort_their_own_seconds_only(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(str(i), base + dt.timedelta(seconds=i // 4 * 977 % 300_000, microseconds=i % 4 // 2)) for i in range(4000)]
    df = spark.createDataFrame(data, "id string, timestamp timestamp_ntz").repartition(5)
    rows = [r[0] for r in sorted(data, key=lambda r: (-(r[1] - base).total_seconds(), r[0]))]
    for offset, n in ((990, 20), (1500, 10), (3990, 30), (4000, 5), (0, 2000), (5000, 10), (1, 3999)):
        got = ordered_page(df, newest_first(), offset, n)
        assert [r.id for r in got.collect()] == rows[offset : offset + n], (offset, n)
    deep = ordered_page(df, newest_first(), 2000, 10)
    assert "WindowGroupLimit" not in plan_text(deep) and "timestamp" in plan_text(deep)
    assert ordered_page(df.limit(0), newest_first(), 2000, 10).count() == 0


def test_audit_of_any_permit_counts_before_it_ranks(spark):
    logged = reqs.request_log(fx.requests(spark, SF))
    for permit in (0, 5, 1000):
        p = plan_text(reqs.rate_audit(logged, permit=permit))
        assert "row_number" not in p and "HashAggregate" in p
    with pytest.raises(ValueError):
        reqs.rate_audit(logged, permit=-1)
