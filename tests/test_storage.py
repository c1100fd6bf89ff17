"""Stored layout, schema evolution, retention on month partitions, exports."""

import datetime as dt
import os

from pyspark.sql import functions as F

from logsmith.operators import export, retention
from logsmith.schema import LOGS_SCHEMA, LOG_DEFAULTS, add_missing_columns
from logsmith.sources import fixtures as fx
from logsmith.sources.sinks import read_logs, write_logs

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2024, 1, 31)


def test_schema_evolution_defaults(spark):
    df = spark.createDataFrame([("1", dt.datetime(2024, 1, 1), "Info", "a", "m")],
                               "id string, timestamp timestamp_ntz, level string, app_name string, message string")
    out = add_missing_columns(df, LOGS_SCHEMA, LOG_DEFAULTS)
    assert out.columns == [f.name for f in LOGS_SCHEMA.fields]
    r = out.first()
    assert (r.environment, r.status_code, r.duration_ms, r.metadata, r.project_id) == ("production", 0, 0.0, "{}", None)


def test_write_read_and_retention(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    src = fx.logs(spark, SF)
    write_logs(src, path, rewrite=True)
    stored = read_logs(spark, path)
    assert stored.count() == src.count()
    assert os.path.isdir(f"{path}/month=202401")
    # rows within each file are clustered by (app_name, level, timestamp)
    res = retention.apply_retention(spark, path, AS_OF, 10, f"{tmp_dir}/stage")
    assert res["rewritten_months"] == [202401]
    kept = read_logs(spark, path)
    expect = src.where(F.col("timestamp") >= F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in expect.collect())


def test_retention_drops_whole_months(spark, tmp_dir):
    rows = [(str(i), dt.datetime(2023, 11 + i, 15) if i < 2 else dt.datetime(2024, 1, 20), "Info", "a", "m")
            for i in range(3)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, level string, app_name string, message string")
    write_logs(df, f"{tmp_dir}/t", rewrite=True)
    res = retention.apply_retention(spark, f"{tmp_dir}/t", AS_OF, 30, f"{tmp_dir}/stage")
    assert res["dropped_months"] == [202311, 202312]
    assert [r.id for r in read_logs(spark, f"{tmp_dir}/t").collect()] == ["2"]


def test_retention_ttl_and_delete_all(spark):
    df = fx.logs(spark, SF)
    assert retention.delete_all(df).count() == 0
    n = retention.ttl_expire(df, AS_OF, 0).count()  # non-positive -> 30 days -> keeps everything after Jan 1
    assert n == df.where(F.col("created_at") > F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).count()


def test_export_line_format(spark):
    from logsmith.schema import LOGS_SCHEMA
    row = ("x1", dt.datetime(2024, 1, 2, 3, 4, 5, 678000), "Warning", "", 'said "hi"\nbye', "{}", "", "", "", "",
           "GET", "/p", 0, 12.5, "", "t", "", "", "production", None, "", dt.datetime(2024, 1, 2))
    df = spark.createDataFrame([row], LOGS_SCHEMA)
    assert export.log_lines(df).first().line == '[2024-01-02 03:04:05.678] WRN  said "hi"\nbye | {}'
    line = export.csv_lines(df).first().line
    assert line == ('x1,2024-01-02T03:04:05.678,Warning,"",production,,"said ""hi""\\nbye",,,,"",GET,/p,,12.5,t,"{}"')
    assert export.csv_header_line().startswith("id,timestamp,level,appName")
    whole = spark.createDataFrame([row[:1] + (dt.datetime(2024, 1, 2, 3, 4, 5, 500000),) + row[2:]], LOGS_SCHEMA)
    assert export.csv_lines(whole).first().line.startswith("x1,2024-01-02T03:04:05.5,")


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_retention_finishes_an_interrupted_swap(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    src = fx.logs(spark, SF)
    write_logs(src, path, rewrite=True)
    kept = read_logs(spark, path).where(F.col("timestamp") >= F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    expect = _ids(kept)
    # an earlier run announced its swap, and died with half of the month gone
    kept.write.partitionBy("month").parquet(f"{tmp_dir}/stage/old")
    half = kept.where("int(id) % 2 = 0").cache()
    half.count()
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    retention._note(spark, path, f"{tmp_dir}/stage/old")
    retention.apply_retention(spark, path, AS_OF, 10, f"{tmp_dir}/stage")
    assert _ids(read_logs(spark, path)) == expect and retention._pending(spark, path) is None


def test_retention_keeps_rows_that_arrive_later(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    src = fx.logs(spark, SF)
    expect = _ids(src.where(F.col("timestamp") >= F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")))
    for k in range(3):
        write_logs(src.where(f"int(id) % 3 = {k}"), path)
        retention.apply_retention(spark, path, AS_OF, 10, f"{tmp_dir}/stage")
    assert _ids(read_logs(spark, path)) == expect


def test_retention_and_ttl_on_the_landing_sink(spark, tmp_dir):
    from logsmith.streaming.ingest import write_batch_partitions

    path = f"{tmp_dir}/landing"
    src = fx.logs(spark, SF)
    early = src.where("timestamp < TIMESTAMP_NTZ'2024-01-10 00:00:00'")
    for k, part in enumerate((early, src.where("timestamp >= TIMESTAMP_NTZ'2024-01-10 00:00:00'"))):
        write_batch_partitions(part, path, k)
    res = retention.apply_retention(spark, path, AS_OF, 10, f"{tmp_dir}/stage")
    assert res["dropped_months"] == [(0, 202401)] and res["rewritten_months"] == [(1, 202401)]
    expect = src.where("timestamp >= TIMESTAMP_NTZ'2024-01-21 00:00:00'")
    assert _ids(spark.read.parquet(path)) == _ids(expect)
    retention.apply_ttl(spark, path, AS_OF, f"{tmp_dir}/stage", ttl_days=5)
    assert _ids(spark.read.parquet(path)) == _ids(src.where("created_at > TIMESTAMP_NTZ'2024-01-26 00:00:00'"))
    write_batch_partitions(early, path, 2)
    assert spark.read.parquet(path).count() > 0
    assert retention.delete_all_stored(spark, path) == 2


def test_csv_files_start_with_their_header(spark, tmp_dir):
    from logsmith.sources.sinks import export_csv

    lines = export.csv_lines(fx.logs(spark, SF).repartition(3))
    export_csv(lines, f"{tmp_dir}/csv", export.csv_header_line())
    files = [f for f in os.listdir(f"{tmp_dir}/csv") if f.startswith("part-")]
    for name in files:
        with open(f"{tmp_dir}/csv/{name}", encoding="utf-8") as fh:
            content = fh.read().split("\n")
        assert content[0] == export.csv_header_line() and content.count(content[0]) == 1
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_dir}/csv").count() == lines.count()


def test_numbers_are_printed_as_plain_decimals(spark):
    values = [12345678.5, 0.0001, 0.000001, 1e-7, 2.5e-8, 100.0, 0.0, None, -0.25, 1e15, 123456789012.125]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(export._number("x")).collect()]
    assert got == ["12345678.5", "0.0001", "0.000001", "1e-7", "2.5e-8", "100", "", "", "-0.25", "1000000000000000",
                   "123456789012.125"]
