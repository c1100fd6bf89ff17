"""Ingest: golden request bodies, rejection reasons, key dedupe."""

import datetime as dt
import json

from logsmith.operators import enrich
from logsmith.schema import PROJECTS_SCHEMA, RAW_LOGS_SCHEMA

T0 = dt.datetime(2024, 1, 20, 12, 0, 0, 123456)

SINGLE = {
    "level": "error", "message": "belt 3 jammed", "appName": "sorter", "environment": "staging", "userId": "op-17",
    "source": "BeltMonitor", "exceptionType": "JamError", "exceptionMessage": "no movement for 9 s",
    "exceptionStacktrace": "in belt.watch", "requestMethod": "PUT", "requestPath": "/belts/3", "statusCode": 503,
    "durationMs": 9000.25, "traceId": "t-belt", "spanId": "s-9", "metadata": {"belt": 3, "load": 0.75},
}
BATCH = {"logs": [
    {"level": "info", "message": "parcel in", "appName": "intake", "traceId": "t-77", "metadata": {"kg": 2}},
    {"level": "debug", "message": "weighed", "appName": "scale", "traceId": "t-77"},
    {"level": "info", "message": "parcel out", "appName": "intake", "traceId": "t-77", "durationMs": 31.5,
     "statusCode": 204},
]}


def projects(spark):
    rows = [
        ("p1", "Shop", "key-live", dt.datetime(2023, 12, 1), None),
        ("p2", "Old", "key-old", dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 10)),
        ("p3", "Soon", "key-soon", dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 20, 12, 0, 0, 123456)),
    ]
    return spark.createDataFrame(rows, PROJECTS_SCHEMA)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_LOGS_SCHEMA)


def test_single_golden(spark):
    df = raw(spark, [(1, T0, "key-live", "10.1.1.1", json.dumps(SINGLE))])
    out = enrich.to_logs(enrich.ingest_records(df, projects(spark))).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.level, r.status_code, r.duration_ms) == ("Error", 503, 9000.25)
    assert r.metadata == '{"belt":3,"load":0.75}'
    assert (r.project_id, r.project_name, r.host) == ("p1", "Shop", "10.1.1.1")
    assert r.timestamp == dt.datetime(2024, 1, 20, 12, 0, 0, 123000)


def test_batch_golden(spark):
    df = raw(spark, [(7, T0, "key-live", "10.1.1.1", json.dumps(BATCH))])
    out = enrich.to_logs(enrich.ingest_batches(df, projects(spark)), id_col="entry_id").orderBy("id").collect()
    assert [r.id for r in out] == ["7-0", "7-1", "7-2"]
    assert {r.trace_id for r in out} == {"t-77"}
    assert {r.environment for r in out} == {"production"}
    assert [r.level for r in out] == ["Info", "Debug", "Info"]
    assert out[0].metadata == '{"kg":2}' and out[1].metadata == "{}"
    assert out[2].duration_ms == 31.5 and out[2].status_code == 204


def test_rejections(spark):
    rows = [
        (1, T0, None, "ip", "{}"),
        (2, T0, "", "ip", "{}"),
        (3, T0, "key-unknown", "ip", "{}"),
        (4, T0, "key-old", "ip", "{}"),
        (5, T0, "key-live", "ip", "{not json"),
        (6, T0, "key-live", "ip", None),
        (7, T0, "key-soon", "ip", "{}"),  # expires exactly now -> still valid
        (8, T0 + dt.timedelta(microseconds=1), "key-soon", "ip", "{}"),  # one microsecond late -> expired
        (9, T0, "key-live", "ip", '{"statusCode": "abc"}'),
        (10, T0, "key-live", "ip", ""),
        (11, T0, "key-live", "ip", "  \n"),
        (12, T0, "key-live", "ip", "null"),
        (13, T0, "key-live", "ip", "[]"),
    ]
    c = enrich.ingest_records(raw(spark, rows), projects(spark))
    got = {r.raw_id: r.reason for r in enrich.rejected(c).collect()}
    assert got == {1: "missing_key", 2: "missing_key", 3: "unknown_key", 4: "expired_key", 5: "malformed",
                   6: "malformed", 8: "expired_key", 9: "malformed", 10: "malformed", 11: "malformed",
                   12: "malformed", 13: "malformed"}
    ok = enrich.to_logs(c).collect()
    assert [r.id for r in ok] == ["7"]
    assert (ok[0].level, ok[0].message, ok[0].app_name, ok[0].environment, ok[0].metadata) == (
        "Info", "", "", "production", "{}")


def test_metadata_stays_json(spark):
    bodies = ['{"metadata":"abc"}', '{"metadata":"{\\"a\\":1}"}', '{"metadata":{"b":1,"a":2}}', '{"metadata":[1,"x"]}', '{"metadata":5}',
              '{"metadata":null}', "{}"]
    want = ['"abc"', '"{\\"a\\":1}"', '{"b":1,"a":2}', '[1,"x"]', "5", "{}", "{}"]
    df = raw(spark, [(i, T0, "key-live", "ip", b) for i, b in enumerate(bodies)])
    one = {int(r.id): r.metadata for r in enrich.to_logs(enrich.ingest_records(df, projects(spark))).collect()}
    assert [one[i] for i in range(len(bodies))] == want
    batch = raw(spark, [(1, T0, "key-live", "ip", '{"logs":[' + ",".join(bodies) + "]}")])
    got = {r.id: r.metadata for r in enrich.to_logs(enrich.ingest_batches(batch, projects(spark)), id_col="entry_id").collect()}
    assert [got[f"1-{i}"] for i in range(len(bodies))] == want


def test_batches_fail_as_a_whole(spark):
    rows = [
        (1, T0, "key-live", "ip", '{"logs":[{"message":"a"},null]}'),
        (2, T0, "key-none", "ip", '{"logs":[]}'),
        (3, T0, "key-live", "ip", '{"logs":[]}'),
        (4, T0, None, "ip", '{"logs":[{"message":"a"},{"message":"b"}]}'),
        (5, T0, "key-live", "ip", " "),
        (6, T0, "key-live", "ip", '{"logs":[{"statusCode":"x"}]}'),
        (7, T0, "key-live", "ip", '{"logs":[{"message":"ok"}]}'),
    ]
    c = enrich.ingest_batches(raw(spark, rows), projects(spark))
    got = sorted((r.raw_id, r.reason) for r in enrich.rejected(c).collect())
    assert got == [(1, "malformed"), (2, "unknown_key"), (4, "missing_key"), (5, "malformed"), (6, "malformed")]
    assert [r.id for r in enrich.to_logs(c, id_col="entry_id").collect()] == ["7-0"]


def test_host_fallback(spark):
    rows = [(1, T0, "key-live", "1.2.3.4", '{"host": ""}'), (2, T0, "key-live", "1.2.3.4", '{"host": "h"}')]
    got = {r.id: r.host for r in enrich.to_logs(enrich.ingest_records(raw(spark, rows), projects(spark))).collect()}
    assert got == {"1": "1.2.3.4", "2": "h"}


def test_key_dedupe_last_wins(spark):
    rows = [
        ("a1", "first", "k", dt.datetime(2024, 1, 1), None),
        ("a2", "second", "k", dt.datetime(2024, 1, 2), None),
        ("b1", "only", "j", dt.datetime(2024, 1, 1), None),
        ("c1", "tie-low", "t", dt.datetime(2024, 1, 1), None),
        ("c2", "tie-high", "t", dt.datetime(2024, 1, 1), None),
    ]
    got = {r.api_key: r.name for r in enrich.dedupe_keys(spark.createDataFrame(rows, PROJECTS_SCHEMA)).collect()}
    assert got == {"k": "second", "j": "only", "t": "tie-high"}


def test_enrichment_uses_latest_key_owner(spark):
    p = projects(spark).unionByName(spark.createDataFrame(
        [("p9", "New owner", "key-old", dt.datetime(2024, 1, 15), None)], PROJECTS_SCHEMA))
    out = enrich.to_logs(enrich.ingest_records(raw(spark, [(1, T0, "key-old", "ip", "{}")]), p)).collect()
    assert [(r.project_id, r.project_name) for r in out] == [("p9", "New owner")]


def test_select_by_ids(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(10)], "id string, v int")
    ids = spark.createDataFrame([("3",), ("5",), ("5",), ("42",)], "id string")
    assert sorted(r.v for r in enrich.select_by_ids(df, ids).collect()) == [3, 5]


def test_batch_ingest_job_stages_once(spark, tmp_dir):
    from logsmith.operators.batch_ingest import run_batch_ingest
    from logsmith.sources import fixtures as fx
    from logsmith.sources.sinks import read_logs

    sf = "/root/testdata/sf0.001"
    raw, proj = fx.raw_logs(spark, sf), fx.projects(spark, sf)
    for _ in range(2):  # a second run of the same job adds nothing
        res = run_batch_ingest(spark, raw, proj, f"{tmp_dir}/logs", f"{tmp_dir}/rej", f"{tmp_dir}/stage")
    stored = read_logs(spark, f"{tmp_dir}/logs")
    expect = enrich.to_logs(enrich.ingest_records(raw, proj))
    assert res["accepted"] == stored.count() == expect.count()
    assert res["rejected"] == spark.read.parquet(f"{tmp_dir}/rej").count() == raw.count() - expect.count()
    cols = ["id", "level", "app_name", "message", "metadata", "host", "environment", "status_code", "project_id"]
    assert sorted(map(tuple, stored.select(*cols).collect())) == sorted(map(tuple, expect.select(*cols).collect()))


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    from logsmith.plans.inspect import plan_text

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, T0, None if i % 3 else "", "ip", "{}") for i in range(300)] + [(999, T0, "key-live", "ip", "{}")]
        c = enrich.ingest_records(raw(spark, rows), projects(spark))
        assert "SortMergeJoin" in plan_text(c)
        sizes = [n for n in c.rdd.glom().map(len).collect() if n]
        assert sum(sizes) == 301 and max(sizes) < 150
        assert {r.reject_reason for r in c.collect()} == {"missing_key", None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
