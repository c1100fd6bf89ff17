"""Tables under a manifest: versions, commits on top of each other, and jobs that die half-way."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from logsmith.operators import retention
from logsmith.sources import fixtures as fx
from logsmith.sources import manifest
from logsmith.sources.manifest import Conflict, app_logs_table, logs_table
from logsmith.sources.sinks import read_logs, write_logs

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2024, 1, 31)
ROW = "id string, timestamp timestamp_ntz, level string, app_name string, message string, created_at timestamp_ntz"


def rows(spark, *at):
    """Rows (id, timestamp[, insert time])."""
    full = [(i, t, "Info", "a", "m", c) for i, t, c in ((*x, x[1])[:3] for x in at)]
    return spark.createDataFrame(full, ROW).coalesce(1)


def day(month, d, year=2024):
    return dt.datetime(year, month, d)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_versions_are_read_as_they_were(spark, tmp_dir):
    t = logs_table(spark, f"{tmp_dir}/t")
    assert t.snapshot().version == 0 and ids(t.read()) == []
    assert t.append(rows(spark, ("a", day(1, 1)), ("b", day(2, 1)))) == 1
    assert t.append(rows(spark, ("c", day(1, 5)))) == 2
    assert t.delete_older_than(AS_OF, 29) == 3  # before 2 January
    assert ids(t.read()) == ["b", "c"]
    assert ids(t.read(t.snapshot(2))) == ["a", "b", "c"] and ids(t.read(t.snapshot(1))) == ["a", "b"]
    with pytest.raises(ValueError):
        t.snapshot(9)
    stored = t.read()
    assert stored.columns[-1] == "month" and {r.environment for r in stored.collect()} == {"production"}


def test_whole_lists_and_changes_give_the_same_table(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(manifest, "WHOLE_EVERY", 3)
    t = logs_table(spark, f"{tmp_dir}/t")
    for k in range(7):
        t.append(rows(spark, (f"r{k}", day(1, k + 1))), ("w", k))
    assert ids(t.read()) == [f"r{k}" for k in range(7)] and t.snapshot().steps == {"w": 6}
    t.compact()
    assert ids(t.read()) == [f"r{k}" for k in range(7)] and len(t.snapshot().files) < 7
    assert ids(t.read(t.snapshot(4))) == [f"r{k}" for k in range(4)]


def test_a_repeated_step_changes_nothing(spark, tmp_dir):
    t = logs_table(spark, f"{tmp_dir}/t")
    for _ in range(2):
        t.append(rows(spark, ("a", day(1, 1))), ("stream", 0))
    t.append(rows(spark, ("b", day(1, 1))), ("stream", 1))
    t.append(rows(spark, ("a", day(1, 1))), ("stream", 0))  # an old step again
    t.append(rows(spark, ("c", day(1, 1))), ("other", 0))
    assert ids(t.read()) == ["a", "b", "c"] and t.snapshot().version == 3


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, tmp_dir):
    """Faults of the plain layout: rows that arrive between the stage and the swap of a deletion
    were lost by the next TTL, and a delete-all was undone by the next deletion."""
    t = logs_table(spark, f"{tmp_dir}/t")
    t.append(rows(spark, ("old", day(1, 1)), ("a", day(1, 25)), ("y", day(2, 1), day(1, 1)), ("z", day(2, 2))))
    read = t.snapshot()
    t.write_files(t.scan([f for f in read.files if f.month == 202401]).where("timestamp >= '2024-01-21'"))  # dies here
    t.append(rows(spark, ("new", day(1, 26))))
    t.expire(AS_OF, 20)
    assert ids(t.read()) == ["a", "new", "z"]
    t.write_files(t.read().where("id = 'a'"))  # dies again
    t.delete_all()
    t.append(rows(spark, ("z2", day(1, 30))))
    t.delete_older_than(AS_OF, 10)
    assert ids(t.read()) == ["z2"]


def test_rows_that_arrive_during_a_compaction_stay(spark, tmp_dir, monkeypatch):
    t = logs_table(spark, f"{tmp_dir}/t")
    for k in range(3):
        t.append(rows(spark, (f"r{k}", day(1, k + 1))))
    write, arrived = t.write_files, []

    def slow(df, clustered=0):
        out = write(df, clustered)
        if clustered and not arrived:
            arrived.append(logs_table(spark, t.path).append(rows(spark, ("late", day(1, 9)))))
            assert ids(logs_table(spark, t.path).read()) == ["late", "r0", "r1", "r2"]  # each row once
        return out

    monkeypatch.setattr(t, "write_files", slow)
    t.compact()
    assert ids(t.read()) == ["late", "r0", "r1", "r2"] and len(t.snapshot().files) == 2


def test_a_change_to_files_that_have_left_is_made_again(spark, tmp_dir, monkeypatch):
    t = logs_table(spark, f"{tmp_dir}/t")
    t.append(rows(spark, ("a", day(1, 1)), ("b", day(1, 25))))
    t.append(rows(spark, ("c", day(1, 2)), ("d", day(1, 26))))
    read = t.snapshot()
    t.compact()
    with pytest.raises(Conflict):
        t.commit(read, [], [read.files[0]])
    write, raced = t.write_files, []

    def slow(df, clustered=0):
        out = write(df, clustered)
        if not raced:
            raced.append(logs_table(spark, t.path).delete_older_than(AS_OF, 29))  # a second deletion is first
        return out

    monkeypatch.setattr(t, "write_files", slow)
    t.delete_older_than(AS_OF, 10)
    assert raced and ids(t.read()) == ["b", "d"]


def test_two_writers_at_once_lose_nothing(spark, tmp_dir):
    t = logs_table(spark, f"{tmp_dir}/t")
    failed = []

    def write(name):
        try:
            mine = logs_table(spark, t.path)
            for k in range(4):
                mine.append(rows(spark, (f"{name}{k}", day(1, k + 1))))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and ids(t.read()) == sorted(f"{n}{k}" for n in "xy" for k in range(4)) and t.snapshot().version == 8


def test_only_the_files_concerned_are_opened(spark, tmp_dir):
    t = logs_table(spark, f"{tmp_dir}/t")
    t.append(rows(spark, ("a", day(11, 1, 2023)), ("b", day(12, 1, 2023))))
    t.append(rows(spark, ("c", day(1, 1)), ("d", day(1, 25))))
    t.append(rows(spark, ("e", day(1, 28))))
    before = {f.path for f in t.snapshot().files}
    t.delete_older_than(AS_OF, 10)
    after = {f.path for f in t.snapshot().files}
    assert ids(t.read()) == ["d", "e"]
    assert {f.first for f in t.snapshot().files if f.path in before & after} == {"2024-01-28 00:00:00.000000"}
    assert len(t.read(time_from="2024-01-26 00:00:00").inputFiles()) == 1
    assert t.read(time_to="2023-01-01").inputFiles() == []
    version = t.snapshot().version
    assert t.delete_older_than(AS_OF, 10) == version  # nothing more to delete: no new version


def test_ttl_takes_rows_without_an_insert_time_and_edges_are_exact(spark, tmp_dir):
    t = logs_table(spark, f"{tmp_dir}/t")
    edge = dt.datetime(2024, 1, 24)
    t.append(rows(spark, ("at", day(2, 1), edge), ("after", day(2, 1), edge + dt.timedelta(microseconds=250)), ("none", day(2, 1), None)))
    t.expire(AS_OF, 7)
    assert ids(t.read()) == ["after"]
    u = logs_table(spark, f"{tmp_dir}/u")
    u.append(rows(spark, ("at", day(1, 21)), ("before", dt.datetime(2024, 1, 20, 23, 59, 59, 999999))))
    u.delete_older_than(AS_OF, 10)
    assert ids(u.read()) == ["at"]


def test_vacuum_removes_what_no_kept_version_names(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(manifest, "WHOLE_EVERY", 2)
    t = logs_table(spark, f"{tmp_dir}/t")
    for k in range(4):
        t.append(rows(spark, (f"r{k}", day(1, k + 1))))
    t.compact()
    t.write_files(rows(spark, ("lost", day(1, 1))))
    assert t.vacuum(keep_versions=1) == 0  # too young: another commit may be under way
    assert t.vacuum(keep_versions=1, orphan_seconds=-60) == 5
    assert ids(t.read()) == ["r0", "r1", "r2", "r3"] and t.versions()[0] > 1
    t.append(rows(spark, ("more", day(1, 9))))
    assert ids(t.read()) == ["more", "r0", "r1", "r2", "r3"]


def test_request_log_table(spark, tmp_dir):
    t = app_logs_table(spark, f"{tmp_dir}/t")
    t.append(fx.app_logs(spark, SF))
    t.compact(files_over=0)
    t.delete_older_than(AS_OF, 10)
    assert ids(t.read()) == ids(fx.app_logs(spark, SF).where("timestamp >= TIMESTAMP_NTZ'2024-01-21 00:00:00'"))


# ---------------------------------------------------------------- the plain layout


def _stopped_retention(spark, path, stage):
    """A deletion that dies after its note: everything before 21 January was to go."""
    kept = read_logs(spark, path).where("month = 202401 AND timestamp >= TIMESTAMP_NTZ'2024-01-21 00:00:00'")
    kept.write.partitionBy("month").parquet(stage)
    retention._note(spark, path, stage, "timestamp >= TIMESTAMP_NTZ'2024-01-21 00:00:00'", [(202401,)])


def test_ttl_after_a_stopped_deletion_loses_nothing(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    write_logs(rows(spark, ("old", day(1, 1)), ("a", day(1, 25)), ("x", day(2, 1), day(1, 1)), ("y", day(2, 2))), path)
    _stopped_retention(spark, path, f"{tmp_dir}/stopped")
    write_logs(rows(spark, ("new", day(1, 26))), path)
    retention.apply_ttl(spark, path, AS_OF, f"{tmp_dir}/stage", ttl_days=20)
    assert ids(read_logs(spark, path)) == ["a", "new", "y"] and retention._pending(spark, path) is None


def test_delete_all_after_a_stopped_deletion_stays_deleted(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    write_logs(rows(spark, ("old", day(1, 1)), ("a", day(1, 25))), path)
    _stopped_retention(spark, path, f"{tmp_dir}/stopped")
    retention.delete_all_stored(spark, path)
    write_logs(rows(spark, ("z2", day(1, 30))), path)
    retention.apply_retention(spark, path, AS_OF, 10, f"{tmp_dir}/stage")
    assert ids(read_logs(spark, path)) == ["z2"]


def test_a_stopped_deletion_is_finished_without_an_edge_month(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    write_logs(rows(spark, ("old", day(1, 1)), ("a", day(1, 25))), path)
    _stopped_retention(spark, path, f"{tmp_dir}/stopped")
    retention.apply_retention(spark, path, dt.datetime(2024, 1, 2), 30, f"{tmp_dir}/stage")  # the cutoff lies in December
    assert ids(read_logs(spark, path)) == ["a"] and retention._pending(spark, path) is None


def test_tasks_of_a_rewrite_follow_the_bytes(spark, tmp_dir, monkeypatch):
    """A rewrite into one task becomes several when there is more than a task should sort."""
    from logsmith.sources import manifest

    t = logs_table(spark, f"{tmp_dir}/t")
    t.append(rows(spark, *((f"r{i}", day(1, 1 + i % 28)) for i in range(200))))
    stored = sum(f.bytes for f in t.snapshot().files)
    assert len(t.write_files(t.read(), 1)) == 1
    monkeypatch.setattr(manifest, "SORT_BYTES", stored // 4)
    assert len(t.write_files(t.read(), 1)) >= 4
    t.append(rows(spark, ("more", day(1, 1))))
    t.compact()
    assert len(t.snapshot().files) >= 4 and len(ids(t.read())) == 201


def test_a_version_is_made_once(spark, tmp_dir):
    t = logs_table(spark, f"{tmp_dir}/t")
    t.append(rows(spark, ("a", day(1, 1))))
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append(t._publish(2, {"whole": False, "add": [], "remove": [], "steps": {str(k): k}})))
               for k in range(24)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sum(made) == 1 and len(made) == 24 and t.versions() == [1, 2] and len(t._load(2)["steps"]) == 1


def test_a_spread_load_sorts_in_tasks_of_the_advised_size(spark, tmp_dir):
    """Few rows make one file a month; many are split further than the shuffle partitions are."""
    t = logs_table(spark, f"{tmp_dir}/t")
    t.append(fx.logs(spark, SF), spread=True)
    assert len(t.snapshot().files) == t.read().select("month").distinct().count()
    keys = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k, None) for k in keys}
    many = fx.logs(spark, "/root/testdata/sf0.01").repartition(12, "id")
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        t.append(many, spread=True)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = [f for f in t.snapshot().files if f.rows > 0]
    assert len(files) > 3 and t.snapshot().rows == fx.logs(spark, SF).count() + many.count()
