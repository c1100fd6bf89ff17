"""What stands on tables under a manifest: file indexes, the rollup, envelopes on the stream; and
key history and many tails."""

import datetime as dt
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logsmith.operators import enrich, rollup, stats, traces
from logsmith.operators.patterns import log_patterns
from logsmith.operators.filters import LogFilter, filter_logs
from logsmith.plans.topk import ordered_page
from logsmith.operators.search import newest_first
from logsmith.schema import RAW_LOGS_SCHEMA
from logsmith.sources import fixtures as fx
from logsmith.sources.file_index import MESSAGE_INDEX, TRACE_INDEX, grams
from logsmith.sources.manifest import logs_table, rejections_table
from logsmith.streaming import ingest as s_ingest
from logsmith.streaming import tail as s_tail

SF = "/root/testdata/sf0.001"
ROW = "id string, timestamp timestamp_ntz, level string, app_name string, message string, trace_id string"
T0 = dt.datetime(2024, 1, 30)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def rows(spark, made):
    return spark.createDataFrame(made, ROW).coalesce(1)


# ---------------------------------------------------------------- file indexes


def test_a_trace_opens_only_its_files(spark, tmp_dir):
    t = logs_table(spark, f"{tmp_dir}/t", (TRACE_INDEX,))
    for k in range(4):
        t.append(rows(spark, [(f"{k}-{i}", T0 + dt.timedelta(days=-9 * k, seconds=i), "Info", "a", "m", f"trace-{k // 2}" if i else "") for i in range(5)]))
    found = t.read_holding(TRACE_INDEX, ["trace-1"])
    assert len(found.inputFiles()) == 2 and ids(found.where("trace_id = 'trace-1'")) == [f"{k}-{i}" for k in (2, 3) for i in range(1, 5)]
    assert t.read_holding(TRACE_INDEX, ["none"]).inputFiles() == []
    t.compact()
    assert ids(traces.trace_timeline(t.read_holding(TRACE_INDEX, ["trace-0"]), "trace-0")) == [f"{k}-{i}" for k in (0, 1) for i in range(1, 5)]


def test_files_written_before_an_index_existed_are_searched(spark, tmp_dir):
    logs_table(spark, f"{tmp_dir}/t").append(rows(spark, [("old", T0, "Info", "a", "m", "x")]))
    t = logs_table(spark, f"{tmp_dir}/t", (TRACE_INDEX,))
    t.append(rows(spark, [("new", T0, "Info", "a", "m", "x"), ("other", T0, "Info", "a", "m", "y")]))
    assert ids(t.read_holding(TRACE_INDEX, ["x"]).where("trace_id = 'x'")) == ["new", "old"]
    t.delete_all()
    t.vacuum(keep_versions=1, orphan_seconds=-60)
    assert t._list(f"{tmp_dir}/t/index/trace") == []


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    rng = random.Random(4)
    table = logs_table(spark, str(tmp_path_factory.mktemp("searched")), (MESSAGE_INDEX,))
    messages = ["", "ab", "Order 17 paid 100%_OK", "İstanbul ẞtraße ÇA", "日本語テスト", "x" * 50, None]
    messages += ["".join(rng.choices("abcABC %_İß日", k=rng.randint(0, 12))) for _ in range(60)]
    for k in range(4):
        made = [(f"{i:03}", T0, "Info", "a", m or "", "") for i, m in enumerate(messages) if i % 4 == k]
        table.append(rows(spark, made))
    return table, [m or "" for m in messages]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_a_search_loses_nothing(spark, searched, data):
    table, messages = searched
    whole = data.draw(st.sampled_from(messages))
    a = data.draw(st.integers(0, len(whole)))
    needle = whole[a : a + data.draw(st.integers(1, 6))] or "zz"
    f = LogFilter(search=needle)
    assert ids(filter_logs(table.read_holding(MESSAGE_INDEX, grams(needle)), f)) == ids(filter_logs(table.read(), f))


def test_a_search_skips_files(spark, searched):
    table, _ = searched
    assert len(table.read_holding(MESSAGE_INDEX, grams("PAID 100%")).inputFiles()) == 1
    assert len(table.read_holding(MESSAGE_INDEX, grams("ab")).inputFiles()) == 4  # too short to be looked up


# ---------------------------------------------------------------- rollup


def test_maintained_figures_are_those_of_a_scan(spark, tmp_dir):
    rng = random.Random(6)
    as_of = dt.datetime(2024, 1, 31, 10, 30, 17, 250_000)
    made = []
    for i in range(1500):
        back = rng.choice([dt.timedelta(hours=24), dt.timedelta(hours=1), dt.timedelta(hours=rng.randint(0, 60))])
        t = as_of - back + dt.timedelta(microseconds=rng.choice([0, 1, -1, rng.randint(-90_000_000, 90_000_000)]))
        made.append((f"{i:04}", t, rng.choice(["Error", "Warning", "Info"]), f"app{i % 15}", "m", ""))
    logs, counts = logs_table(spark, f"{tmp_dir}/logs"), rollup.rollup_table(spark, f"{tmp_dir}/minutes")
    for k in range(3):
        rollup.append_with_rollup(logs, counts, rows(spark, made[k::3]), ("w", k))
    rollup.append_with_rollup(logs, counts, rows(spark, made[1::3]), ("w", 1))  # a repeated step
    whole = rows(spark, made)
    for at in (as_of, dt.datetime(2024, 1, 31, 10, 30), as_of - dt.timedelta(days=40), as_of + dt.timedelta(days=40)):
        assert rollup.log_stats(logs, counts, at).collect() == stats.log_stats(whole, at).collect()
        assert rollup.top_apps(logs, counts, at).collect() == stats.top_apps(whole, at).collect()
    rollup.fold(counts)
    assert rollup.log_stats(logs, counts, as_of).collect() == stats.log_stats(whole, as_of).collect()


def test_few_rows_are_read_for_maintained_figures(spark, tmp_dir):
    busy = spark.range(40_000).selectExpr(
        "cast(id as string) as id", "timestampadd(MILLISECOND, id * 5400, TIMESTAMP_NTZ'2024-01-28 00:00:00') as timestamp",
        "if(id % 7 = 0, 'Error', 'Info') as level", "concat('app', id % 3) as app_name", "'m' as message")
    logs, counts = logs_table(spark, f"{tmp_dir}/logs"), rollup.rollup_table(spark, f"{tmp_dir}/minutes")
    rollup.append_with_rollup(logs, counts, busy.repartitionByRange(12, "timestamp"), ("w", 0))
    plan = rollup._counted(logs, counts, "2024-01-30 12:00:30")
    files = [f for f in plan.inputFiles() if "/logs/" in f]
    held = {f.path: f.rows for f in logs.snapshot().files}
    assert 0 < len(files) <= 4 < len(held)  # the files of two minutes
    assert rollup.log_stats(logs, counts, "2024-01-30 12:00:30").collect() == stats.log_stats(busy, "2024-01-30 12:00:30").collect()


def test_maintained_patterns_are_those_of_a_scan(spark, tmp_dir):
    rng = random.Random(8)
    as_of = dt.datetime(2024, 1, 31, 10, 30, 17)
    made = [(f"{i:04}", as_of - dt.timedelta(seconds=rng.choice([86_400, 86_399, rng.randint(0, 200_000)])),
             rng.choice(["Error", "Info"]), f"app{i % 3}", f"took {rng.randint(1, 999)} ms in {rng.choice('xyz')}", "") for i in range(800)]
    logs, hours = logs_table(spark, f"{tmp_dir}/logs"), rollup.pattern_table(spark, f"{tmp_dir}/hours")
    minutes = rollup.rollup_table(spark, f"{tmp_dir}/minutes")
    for k in (0, 1, 1):
        rollup.append_with_rollup(logs, minutes, rows(spark, made[k::2]), ("w", k), hours)
    whole = rows(spark, made)
    assert rollup.log_patterns(logs, hours, as_of).collect() == log_patterns(whole, as_of).collect()
    rollup.fold(hours)
    for args in ({"hours": 3, "levels": "Error"}, {"min_count": 20, "limit": 4}, {"app_name": "app1", "hours": 48}):
        assert rollup.log_patterns(logs, hours, as_of, **args).collect() == log_patterns(whole, as_of, **args).collect()


# ---------------------------------------------------------------- envelopes on the stream


def test_envelopes_on_the_stream_are_all_or_nothing_and_count_once(spark, tmp_dir):
    key = lambda ok: "demo_key_2" if ok else "no such key"
    item = lambda i: {"level": "Error", "message": f"m{i}", "appName": "a", "metadata": "note" if i % 2 else {"k": i}}
    bodies = [json.dumps({"logs": [item(10 * n + i) for i in range(3)]}) for n in range(6)]
    bodies[2] = bodies[2].replace("]}", ",null]}")
    bodies[3] = '{"logs":[]}'
    raw = [(n, dt.datetime(2024, 1, 15), key(n != 4), "10.0.0.1", b) for n, b in enumerate(bodies)] + [(6, dt.datetime(2024, 1, 15), key(True), "", "{")]
    df = spark.createDataFrame(raw, RAW_LOGS_SCHEMA)
    df.repartition(4).write.parquet(f"{tmp_dir}/raw")
    logs, bad = logs_table(spark, f"{tmp_dir}/logs"), rejections_table(spark, f"{tmp_dir}/bad")
    args = (spark, f"{tmp_dir}/raw", lambda: fx.projects(spark, SF), logs, bad)
    s_ingest.start_log_ingest(*args, f"{tmp_dir}/c", available_now=True, max_files_per_trigger=1, envelopes=True).awaitTermination()
    batch = enrich.ingest_batches(df, fx.projects(spark, SF))
    want = sorted((r.id, r.message, r.metadata) for r in enrich.to_logs(batch, "entry_id").collect())
    assert sorted((r.id, r.message, r.metadata) for r in logs.read().collect()) == want and len(want) == 9
    assert sorted(r.raw_id for r in bad.read().collect()) == [2, 4, 6]
    # a batch that is replayed after its commit changes nothing
    run = s_ingest.log_ingest_batch(lambda: fx.projects(spark, SF), logs, bad, envelopes=True, writer=f"{tmp_dir}/c")
    run(s_ingest.parse_envelopes(df), 0)
    assert len(ids(logs.read())) == 9


# ---------------------------------------------------------------- key history


def test_a_replay_in_a_later_state_gives_the_same_rows(spark):
    schema = "id string, name string, api_key string, created_at timestamp_ntz, expires_at timestamp_ntz"
    day = lambda d: dt.datetime(2024, 1, d)
    first = [("p1", "Shop", "k1", day(1), None), ("p2", "Old", "k2", day(1), day(10))]
    later = first + [("p1", "Renamed", "k1", day(12), None), ("p1", "Gone", "k1", day(20), day(20)), ("p2", "Again", "k2", day(15), None)]
    raw = [(i, day(d), k, "", '{"level":"Info","message":"m"}') for i, (d, k) in enumerate(
        [(5, "k1"), (11, "k1"), (5, "k2"), (11, "k2"), (12, "k1"), (16, "k2"), (21, "k1"), (5, "k9"), (5, None), (1, "k1")])]
    raw.append((99, dt.datetime(2023, 12, 1), "k1", "", '{"level":"Info"}'))  # before the key existed
    df = spark.createDataFrame(raw, RAW_LOGS_SCHEMA)

    def told(history):
        out = enrich.ingest_records_as_of(df, spark.createDataFrame(history, schema))
        return {r.raw_id: (r.project_name, r.reject_reason) for r in out.collect()}

    then, now = told(first), told(later)
    assert [then[i] for i in (0, 1, 2, 3, 9)] == [now[i] for i in (0, 1, 2, 3, 9)] == [
        ("Shop", None), ("Shop", None), ("Old", None), ("Old", "expired_key"), ("Shop", None)]
    assert now[4] == ("Renamed", None) and now[5] == ("Again", None) and now[6] == ("Gone", "expired_key")
    assert now[7] == (None, "unknown_key") and now[8] == (None, "missing_key") and now[99] == (None, "unknown_key")


# ---------------------------------------------------------------- many tails


def test_many_tails_equal_single_ones_in_one_scan(spark):
    logs = fx.logs(spark, SF)
    filters = {f"t{i}": LogFilter(app_name=f"svc-{i % 14}", levels="Error,Fatal,Warning" if i % 3 else None,
                                  search="user" if i % 4 == 0 else None) for i in range(100)}
    every = s_tail.newest_of_each(logs, filters, rows=5)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan
    got = {}
    for r in every.collect():
        got.setdefault(r.tail, []).append(r.id)
    for name in ("t0", "t1", "t5", "t13", "t50", "t99"):
        single = ordered_page(filter_logs(logs, filters[name]), newest_first(), 0, 5)
        assert sorted(got.get(name, [])) == ids(single)
    assert s_tail.newest_of_each(logs, {}, rows=5).count() == 0
    with pytest.raises(ValueError):
        s_tail.newest_of_each(logs, filters, rows=5000)
