"""Hot keys (a third of all rows on one key) against brute force, JSON-file ingest, batch
envelope edge cases, and a live processing-time stream."""

import datetime as dt
import json

from pyspark.sql import functions as F

from logsmith.operators import enrich, patterns, stats
from logsmith.schema import PROJECTS_SCHEMA, RAW_LOGS_SCHEMA
from logsmith.sources import fixtures as fx
from logsmith.streaming import tail as s_tail
from logsmith.operators.filters import LogFilter
from logsmith.schema import LOGS_SCHEMA

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 20, 12, 0, 0)
AS_OF = dt.datetime(2024, 1, 31)


def test_hot_app_and_pattern(spark):
    base = fx.logs(spark, SF)
    hot = base.withColumn("app_name", F.when(F.col("id").cast("int") % 3 == 0, F.lit("svc-hot")).otherwise(F.col("app_name")))
    hot = hot.withColumn("message", F.when(F.col("app_name") == "svc-hot", F.lit("Heartbeat 42 ok")).otherwise(F.col("message")))
    rows = hot.collect()
    pats = {(r.pattern, r.level, r.app_name): r.cnt for r in
            patterns.log_patterns(hot, AS_OF, hours=8760, min_count=1, limit=1000).collect()}
    expect = {}
    for r in rows:
        if r.timestamp > AS_OF - dt.timedelta(hours=8760):
            import re
            k = (re.sub("[0-9]+", "*", r.message[:100]), r.level, r.app_name)
            expect[k] = expect.get(k, 0) + 1
    assert pats == expect
    top = {r.app_name: r.log_count for r in stats.top_apps(hot, dt.datetime(2024, 2, 1), limit=50).collect()}
    brute = {}
    for r in rows:
        if r.timestamp > dt.datetime(2024, 1, 31):
            brute[r.app_name] = brute.get(r.app_name, 0) + 1
    assert top == brute


def test_hot_api_key_ingest(spark):
    raw = fx.raw_logs(spark, SF).withColumn(
        "api_key", F.when(F.col("raw_id") % 3 == 0, F.lit("demo_key_7")).otherwise(F.col("api_key")))
    c = enrich.ingest_records(raw, fx.projects(spark, SF))
    got = enrich.to_logs(c).groupBy("project_id").count().collect()
    keys = {r.api_key: r for r in fx.projects(spark, SF).collect()}
    brute = {}
    for r in raw.collect():
        p = keys.get(r.api_key)
        ok = (r.body or "").startswith("{") and r.body.endswith("}")
        if ok and p is not None and (p.expires_at is None or p.expires_at >= r.received_at):
            brute[p.id] = brute.get(p.id, 0) + 1
    assert {r.project_id: r["count"] for r in got} == brute


def test_json_file_source_and_envelopes(spark, tmp_dir):
    recs = [
        {"raw_id": 1, "received_at": "2024-01-20 12:00:00", "api_key": "k", "client_ip": "ip",
         "body": json.dumps({"logs": [{"message": "a"}, {"message": "b", "level": "fatal"}]})},
        {"raw_id": 2, "received_at": "2024-01-20 12:00:00", "api_key": "k", "client_ip": "ip", "body": "{\"logs\": 5"},
        {"raw_id": 3, "received_at": "2024-01-20 12:00:00", "api_key": "k", "client_ip": "ip", "body": "{}"},
    ]
    path = f"{tmp_dir}/raw.jsonl"
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs))
    raw = spark.read.schema(RAW_LOGS_SCHEMA).json(path)
    proj = spark.createDataFrame([("p", "P", "k", dt.datetime(2023, 1, 1), None)], PROJECTS_SCHEMA)
    c = enrich.ingest_batches(raw, proj)
    ok = sorted((r.id, r.message, r.level) for r in enrich.to_logs(c, id_col="entry_id").collect())
    assert ok == [("1-0", "a", "Info"), ("1-1", "b", "Fatal")]
    assert [(r.raw_id, r.reason) for r in enrich.rejected(c).collect()] == [(2, "malformed")]


def test_live_tail_with_processing_time_trigger(spark, tmp_dir):
    src = f"{tmp_dir}/logs"
    logs = fx.logs(spark, SF)
    logs.where("CAST(id AS INT) < 50").write.parquet(f"{src}/a")
    stream = spark.readStream.schema(LOGS_SCHEMA).parquet(src + "/*")
    f = LogFilter(levels="Warning,Error,Fatal")
    q = s_tail.start_tail(spark, stream, f, f"{tmp_dir}/tail", f"{tmp_dir}/ckpt", rows=1000)
    try:
        q.processAllAvailable()
        logs.where("CAST(id AS INT) >= 50").write.parquet(f"{src}/b")
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(r.id for r in s_tail.newest(s_tail.read_tail(spark, f"{tmp_dir}/tail", LOGS_SCHEMA), 1000).collect())
    expect = sorted(r.id for r in logs.where(F.col("level").isin("Warning", "Error", "Fatal")).collect())
    assert got == expect
