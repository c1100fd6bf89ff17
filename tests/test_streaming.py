"""Streaming = batch; restart from checkpoint adds no duplicates; one stamp per batch."""

import os

from pyspark.sql import functions as F

from logsmith.operators import enrich
from logsmith.sources import fixtures as fx
from logsmith.streaming import ingest as s_ingest

SF = "/root/testdata/sf0.001"
COLS = ["id", "level", "app_name", "message", "metadata", "host", "environment", "status_code", "project_id"]


def test_stream_equals_batch_and_restart_is_idempotent(spark, tmp_dir):
    raw = fx.raw_logs(spark, SF)
    first, second = raw.where("raw_id % 2 = 0"), raw.where("raw_id % 2 = 1")
    first.write.option("maxRecordsPerFile", 20).parquet(f"{tmp_dir}/raw/part=a")
    args = (spark, f"{tmp_dir}/raw", lambda: fx.projects(spark, SF), f"{tmp_dir}/logs", f"{tmp_dir}/rej",
            f"{tmp_dir}/ckpt")
    q = s_ingest.start_log_ingest(*args, available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    n1 = spark.read.parquet(f"{tmp_dir}/logs").count()
    # restart on the same checkpoint: nothing new -> nothing re-written
    q = s_ingest.start_log_ingest(*args, available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/logs").count() == n1
    # new files arrive -> only they are processed
    second.write.option("maxRecordsPerFile", 20).parquet(f"{tmp_dir}/raw/part=b")
    q = s_ingest.start_log_ingest(*args, available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/logs")
    assert out.count() == out.select("id").distinct().count()
    batch = enrich.to_logs(enrich.ingest_records(raw, fx.projects(spark, SF)))
    assert sorted(map(tuple, out.select(*COLS).collect())) == sorted(map(tuple, batch.select(*COLS).collect()))
    rej = spark.read.parquet(f"{tmp_dir}/rej")
    assert rej.count() + out.count() == raw.count()
    # T4: every micro-batch carries exactly one processing stamp
    per_batch = out.groupBy("batch_id").agg(F.countDistinct("timestamp").alias("n")).collect()
    assert len(per_batch) > 1 and all(r.n == 1 for r in per_batch)


def test_replayed_batch_overwrites_its_partition(spark, tmp_dir):
    df = spark.createDataFrame([("1", "2024-01-05 00:00:00")], "id string, t string").select(
        "id", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    for _ in range(2):
        s_ingest.write_batch_partitions(df, f"{tmp_dir}/sink", 7)
    assert spark.read.parquet(f"{tmp_dir}/sink").count() == 1
    assert os.path.isdir(f"{tmp_dir}/sink/batch_id=7/month=202401")
    # a replay that is stamped in the next month replaces the first copy
    later = df.withColumn("timestamp", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    s_ingest.write_batch_partitions(later, f"{tmp_dir}/sink", 7)
    assert [r.month for r in spark.read.parquet(f"{tmp_dir}/sink").collect()] == [202402]


def test_failed_batch_is_replayed_without_duplicates(spark, tmp_dir):
    from logsmith.sources.ingest import parse_records

    raw = fx.raw_logs(spark, SF)
    raw.write.option("maxRecordsPerFile", 25).parquet(f"{tmp_dir}/raw")
    loader = lambda: fx.projects(spark, SF)
    run = s_ingest.log_ingest_batch(loader, f"{tmp_dir}/logs", f"{tmp_dir}/rej")
    state = {"failed": False}

    def flaky(batch, batch_id):
        run(batch, batch_id)  # output written ...
        if not state["failed"]:  # ... then the driver dies before the batch commits
            state["failed"] = True
            raise RuntimeError("injected failure after writing the batch")

    parsed = parse_records(s_ingest.read_raw_stream(spark, f"{tmp_dir}/raw", max_files_per_trigger=2))
    q = (parsed.writeStream.foreachBatch(flaky).option("checkpointLocation", f"{tmp_dir}/ckpt")
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001 - the injected failure
        pass
    assert state["failed"]
    q = s_ingest.start_log_ingest(spark, f"{tmp_dir}/raw", loader, f"{tmp_dir}/logs", f"{tmp_dir}/rej",
                                  f"{tmp_dir}/ckpt", available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/logs")
    batch = enrich.to_logs(enrich.ingest_records(raw, fx.projects(spark, SF)))
    assert out.count() == out.select("id").distinct().count() == batch.count()
    assert spark.read.parquet(f"{tmp_dir}/rej").count() + out.count() == raw.count()


def test_compact_landing_month_into_table(spark, tmp_dir):
    from logsmith.sources.sinks import compact_month, read_logs

    raw = fx.raw_logs(spark, SF)
    raw.write.option("maxRecordsPerFile", 20).parquet(f"{tmp_dir}/raw")
    q = s_ingest.start_log_ingest(spark, f"{tmp_dir}/raw", lambda: fx.projects(spark, SF), f"{tmp_dir}/landing",
                                  f"{tmp_dir}/rej", f"{tmp_dir}/ckpt", available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    landing = spark.read.parquet(f"{tmp_dir}/landing")
    months = sorted(r.month for r in landing.select("month").distinct().collect())
    for run in range(2):  # idempotent
        for m in months:
            compact_month(spark, f"{tmp_dir}/landing", f"{tmp_dir}/table", m, f"{tmp_dir}/stage-{run}-{m}")
    table = read_logs(spark, f"{tmp_dir}/table")
    assert table.count() == landing.count() == table.select("id").distinct().count()
    assert sorted(r.id for r in table.collect()) == sorted(r.id for r in landing.collect())


def test_stream_ingest_from_json_lines(spark, tmp_dir):
    raw = fx.raw_logs(spark, SF)
    raw.write.option("maxRecordsPerFile", 40).json(f"{tmp_dir}/raw")
    q = s_ingest.start_log_ingest(spark, f"{tmp_dir}/raw", lambda: fx.projects(spark, SF), f"{tmp_dir}/logs",
                                  f"{tmp_dir}/rej", f"{tmp_dir}/ckpt", fmt="json", available_now=True,
                                  max_files_per_trigger=1)
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/logs")
    batch = enrich.to_logs(enrich.ingest_records(raw, fx.projects(spark, SF)))
    assert sorted(map(tuple, out.select(*COLS).collect())) == sorted(map(tuple, batch.select(*COLS).collect()))


def _requests(rows):
    return "id string, timestamp timestamp_ntz", [(str(i), t) for i, t in enumerate(rows)]


def test_rate_audit_keeps_late_and_replayed_requests(spark, tmp_dir):
    import datetime as dt

    from logsmith.operators import requests as reqs
    from logsmith.streaming import rate

    base = dt.datetime(2024, 1, 5, 10)
    times = [base + dt.timedelta(seconds=37 * i % 4000, milliseconds=i % 3) for i in range(400)]
    late = [base - dt.timedelta(days=31, seconds=5 * i) for i in range(20)]
    schema, rows = _requests(times + late + times[:50])
    df = spark.createDataFrame(rows, schema)
    for k in range(5):  # out of order; the last files are a month late
        df.where(f"int(id) % 5 = {k}" if k < 4 else "int(id) % 5 = 4").coalesce(1).write.parquet(f"{tmp_dir}/in/part={k}")
    for permit, minutes in ((5, 15), (0, 15), (1200, 60)):
        sink = f"{tmp_dir}/sink-{permit}"
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in/*")
        q = rate.start_rate_audit(spark, stream, sink, f"{sink}-ckpt", available_now=True, permit=permit, window_minutes=minutes)
        q.awaitTermination()
        got = rate.audit(spark.read.parquet(sink), permit=permit, window_minutes=minutes)
        want = reqs.rate_audit(df, permit=permit, window_minutes=minutes)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        windows = {}
        for _, t in rows:
            windows.setdefault(dt.datetime(1970, 1, 1) + (t - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=minutes) * dt.timedelta(minutes=minutes), []).append(t)
        brute = {w: (len(ts), sorted(ts)[permit] if len(ts) > permit else None) for w, ts in windows.items()}
        assert {r.window_start: (r.requests, r.first_rejected_at) for r in want.collect()} == brute
        let = reqs.permitted_requests(df, permit=permit, window_minutes=minutes)
        assert let.count() == sum(min(len(ts), permit) for ts in windows.values())


def test_tail_sink_holds_no_more_than_it_shows(spark, tmp_dir):
    from logsmith.schema import LOGS_SCHEMA
    from logsmith.streaming import tail

    logs = fx.logs(spark, SF)
    logs.repartition(6).write.parquet(f"{tmp_dir}/logs")
    stream = spark.readStream.schema(LOGS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/logs")
    q = tail.start_tail(spark, stream, None, f"{tmp_dir}/tail", f"{tmp_dir}/ckpt", available_now=True, rows=7)
    q.awaitTermination()
    held = tail.read_tail(spark, f"{tmp_dir}/tail", LOGS_SCHEMA)
    want = sorted(logs.collect(), key=lambda r: (-r.timestamp.timestamp(), r.id))[:7]
    assert held.count() == 7 and [r.id for r in tail.newest(held).collect()] == [r.id for r in want]
    assert len([d for d in os.listdir(f"{tmp_dir}/tail") if d.startswith("version-")]) <= 2
    assert tail.read_tail(spark, f"{tmp_dir}/none", LOGS_SCHEMA).count() == 0


def test_a_drain_takes_larger_batches_of_a_larger_backlog(spark, tmp_dir, monkeypatch):
    import pytest

    from logsmith import registry

    spark.range(2000).write.parquet(f"{tmp_dir}/in")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_dir}/in") for f in names if not f.endswith(".crc"))
    assert s_ingest.drain_trigger(spark, f"{tmp_dir}/in", 10 * size) == 10 * size
    assert s_ingest.drain_trigger(spark, f"{tmp_dir}/in", 1) == pytest.approx(size / s_ingest.DRAIN_BATCHES, abs=1)
    # files of at least the least trigger: still a bounded number of batches, and all rows
    monkeypatch.setattr(registry, "STREAM_TRIGGER", 1)
    monkeypatch.setattr(s_ingest, "DRAIN_BATCHES", 2)
    registry._stage_input(fx.logs(spark, SF, spread=True), f"{tmp_dir}/logs")
    batches = []
    registry._await(registry._stream(spark, fx.logs(spark, SF).schema, f"{tmp_dir}/logs").writeStream
                    .foreachBatch(lambda b, i: batches.append(b.count())).option("checkpointLocation", f"{tmp_dir}/c")
                    .trigger(availableNow=True).start())
    files = [f for f in os.listdir(f"{tmp_dir}/logs") if f.endswith(".parquet")]
    assert len(files) == 8 and len(batches) <= 3 and sum(batches) == fx.logs(spark, SF).count()


def test_a_drained_backlog_of_many_files_has_few_batches(spark, tmp_dir):
    spark.range(6400).repartition(64).write.parquet(f"{tmp_dir}/in")
    least = s_ingest.drain_trigger(spark, f"{tmp_dir}/in", 1)
    batches = []
    stream = s_ingest.read_raw_stream(spark, f"{tmp_dir}/in", schema="id BIGINT", max_bytes_per_trigger=least)
    (stream.writeStream.foreachBatch(lambda b, i: batches.append(b.count())).option("checkpointLocation", f"{tmp_dir}/c")
     .trigger(availableNow=True).start().awaitTermination())
    assert sum(batches) == 6400 and 2 <= len(batches) <= 10


def _files(top):
    return [f for _, _, names in os.walk(top) for f in names if f.endswith(".parquet")]


def test_a_small_batch_leaves_one_file_for_each_output(spark, tmp_dir):
    """Also if its join is shuffled: the files follow the rows, not the shuffle partitions."""
    from logsmith.sources.ingest import parse_records
    from logsmith.sources.manifest import logs_table, rejections_table

    raw = fx.raw_logs(spark, SF)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        loader = lambda: fx.projects(spark, SF)
        s_ingest.log_ingest_batch(loader, f"{tmp_dir}/logs", f"{tmp_dir}/rej")(parse_records(raw), 0)
        logs, rejected = logs_table(spark, f"{tmp_dir}/t"), rejections_table(spark, f"{tmp_dir}/r")
        s_ingest.log_ingest_batch(loader, logs, rejected)(parse_records(raw), 0)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    months = rejected.read().select("month").distinct().count()
    assert len(_files(f"{tmp_dir}/logs")) == 1 and len(logs.snapshot().files) == 1
    assert len(_files(f"{tmp_dir}/rej")) == months and len(rejected.snapshot().files) == months
    assert logs.snapshot().rows + rejected.snapshot().rows == raw.count()
    assert spark.read.parquet(f"{tmp_dir}/logs").count() == logs.snapshot().rows


def test_a_table_is_compacted_while_its_stream_is_read(spark, monkeypatch):
    from logsmith import registry
    from logsmith.sources.manifest import ManifestTable

    compact, seen = ManifestTable.compact, []

    def watched(table, *args, **kw):
        before = table.snapshot()
        running = len(spark.streams.active)
        version = compact(table, *args, **kw)
        now = table.snapshot()
        seen.append((running, len(before.files), len(before.files) - len({f.path for f in now.files} & {f.path for f in before.files}), now.rows))
        return version

    monkeypatch.setattr(ManifestTable, "compact", watched)
    monkeypatch.setattr(registry, "STREAM_TRIGGER", 1)
    out = registry.QUERIES["stream_ingest_table"](spark, SF)
    (running, files, left, _), (at_end, _, _, rows) = seen
    assert running == 1 and files > 1 and left == files  # beside the stream: what had come was compacted
    assert at_end == 0 and rows == out.count()  # and the rest once it had ended
    batch = enrich.to_logs(enrich.ingest_records(fx.raw_logs(spark, SF), fx.projects(spark, SF)))
    assert sorted(map(tuple, out.select(*COLS).collect())) == sorted(map(tuple, batch.select(*COLS).collect()))
