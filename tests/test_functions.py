"""Golden values of the scalar expressions (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logsmith.functions import (
    cut_stack, level_code, level_short, mask_email, mask_key, metadata_field, metadata_display, parse_level,
    pattern_mask, redact_secrets, relative_age, level_from_status, month_key, to_ms,
)
from logsmith.functions.time import preset_range, truncate_second
from logsmith.operators.filters import canonical_levels, clamp_page, guard, HOURS_RANGE


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_level_parse(spark):
    got = one_col(spark, ["ERROR", "4", "9", "bogus", "Info,Error", None, " warning ", "0", "fatal"], parse_level)
    assert got == ["Error", "Error", "Info", "Info", "Info", "Info", "Warning", "Trace", "Fatal"]
    other = one_col(spark, ["04", "+4", " 005 ", "-0", "-1", "4.0", "99999999999", "", "0x4"], parse_level)
    assert other == ["Error", "Error", "Fatal", "Trace", "Info", "Info", "Info", "Info", "Info"]


def test_level_code_and_short(spark):
    names = ["Trace", "Debug", "Info", "Warning", "Error", "Fatal"]
    assert one_col(spark, names, level_code) == [0, 1, 2, 3, 4, 5]
    assert one_col(spark, names + ["x"], level_short) == ["TRC", "DBG", "INF", "WRN", "ERR", "FTL", "INF"]


def test_redaction(spark):
    got = one_col(spark, ["?apiKey=abc&x=1&TOKEN=z", "?secret=&keep=1", "?x=1"], redact_secrets)
    assert got == ["?apiKey=***&x=1&TOKEN=***", "?secret=***&keep=1", "?x=1"]


def test_email_mask(spark):
    assert one_col(spark, ["bob@x.io", "a@x.io", "none", "@x.io", "ab@c"], mask_email) == [
        "b***@x.io", "***@***", "***@***", "***@***", "a***@c"]


def test_key_mask(spark):
    assert one_col(spark, ["tenant-7f3a9c21d4", "short", "exactly12chr"], mask_key) == [
        "tenant-7...21d4", "short", "exactly12chr"]


def test_stack_cut(spark):
    six = "\n".join(f"l{i}" for i in range(6))
    five = "\n".join(f"l{i}" for i in range(5))
    assert one_col(spark, [six, five, None], cut_stack) == [
        "l0\nl1\nl2\nl3\nl4\n... (truncated)", five, None]


def test_pattern_mask_golden(spark):
    msgs = ["Shard 17 moved to rack 4", "Shard 203 moved to rack 11", "Shard 17 stayed", "Cache warm", "Cache warm"]
    df = spark.createDataFrame([(m,) for m in msgs], "message string")
    got = {tuple(r) for r in df.groupBy(pattern_mask("message").alias("p")).count().collect()}
    assert got == {("Shard * moved to rack *", 2), ("Shard * stayed", 1), ("Cache warm", 2)}


def test_pattern_mask_cuts_before_masking(spark):
    msg = "ı" * 98 + "12345"  # multibyte characters count as characters
    assert one_col(spark, [msg], pattern_mask) == ["ı" * 98 + "*"]


def test_metadata_access(spark):
    meta = '{"thread_id": "belt-2", "line_number": 31, "error_code": "E_JAM"}'
    df = spark.createDataFrame([(meta,), ("not json",)], "metadata string")
    r = df.select(metadata_field("error_code").alias("e"), metadata_field("line_number").alias("n"),
                  metadata_display("metadata").alias("d")).collect()
    assert (r[0]["e"], r[0]["n"]) == ("E_JAM", "31")
    assert r[1]["d"] == "not json"


def test_level_from_status(spark):
    df = spark.createDataFrame([(500, None), (404, None), (200, None), (200, "boom")], "s int, e string")
    got = [r[0] for r in df.select(level_from_status("s", "e")).collect()]
    assert got == ["Error", "Warning", "Information", "Error"]


def test_relative_age(spark):
    base = dt.datetime(2024, 1, 31)
    ts = [base - dt.timedelta(seconds=s) for s in (5, 59.9, 61, 3599, 3601, 86399, 86400 * 3 + 5)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    got = [r[0] for r in df.select(relative_age("t", base)).collect()]
    assert got == ["5s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago", "3d ago"]


def test_time_helpers(spark):
    assert preset_range("2024-01-30 23:59:41.5", 6) == (dt.datetime(2024, 1, 30, 17, 59), dt.datetime(2024, 1, 30, 23, 59))
    assert preset_range("2024-01-30 23:59:41", 0) == (None, None)
    with pytest.raises(ValueError):
        preset_range("2024-01-30", 5)
    assert truncate_second("2024-01-12 08:00:59.999") == dt.datetime(2024, 1, 12, 8, 0, 59)
    assert truncate_second("2024-01-05T03:00:00+03:00") == dt.datetime(2024, 1, 5)
    assert truncate_second(dt.datetime(2024, 1, 4, 19, tzinfo=dt.timezone(dt.timedelta(hours=-5)))) == dt.datetime(2024, 1, 5)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, 1, 2, 3, 456789),)], "timestamp timestamp_ntz")
    r = df.select(to_ms("timestamp").alias("ms"), month_key("timestamp").alias("m")).first()
    assert r["ms"] == dt.datetime(2024, 1, 5, 1, 2, 3, 456000) and r["m"] == 202401


def test_guards_and_clamps():
    assert clamp_page(0, 999) == (1, 500)
    assert clamp_page(None, None) == (1, 50)
    assert clamp_page(3, 0) == (3, 1)
    with pytest.raises(ValueError):
        guard(0, HOURS_RANGE, "hours")
    with pytest.raises(ValueError):
        guard(8761, HOURS_RANGE, "hours")
    assert canonical_levels("error, FATAL ,bogus,", strict=False) == ["Error", "Fatal"]
    with pytest.raises(ValueError):
        canonical_levels("error,bogus", strict=True)


def test_expiry_status_edges(spark):
    from logsmith.operators.projects import project_status
    from logsmith.schema import PROJECTS_SCHEMA
    as_of = dt.datetime(2024, 1, 31)
    rows = [
        ("a", "A", "project-key-zzzz0001", dt.datetime(2023, 12, 1), None),
        ("b", "B", "k", dt.datetime(2023, 12, 1), as_of),  # expires exactly now: still active, 0 days
        ("c", "C", "k2", dt.datetime(2023, 12, 1), as_of - dt.timedelta(seconds=1)),  # expired
        ("d", "D", "k3", dt.datetime(2023, 12, 1), as_of + dt.timedelta(days=6, hours=23)),  # 6 d left, warning
        ("e", "E", "k4", dt.datetime(2023, 12, 1), as_of + dt.timedelta(days=7)),  # 7 d left, no warning
    ]
    got = {r.id: r for r in project_status(spark.createDataFrame(rows, PROJECTS_SCHEMA), as_of).collect()}
    assert (got["a"].status, got["a"].expiry_label, got["a"].expiry_warning, got["a"].masked_key) == (
        "Active", "Never", False, "project-...0001")
    assert (got["b"].status, got["b"].days_left, got["b"].expiry_warning, got["b"].expiry_label) == (
        "Active", 0, True, "2024-01-31 (0d left)")
    assert (got["c"].status, got["c"].expiry_label, got["c"].expiry_warning) == ("Expired", "Expired 2024-01-30", False)
    assert (got["d"].days_left, got["d"].expiry_warning) == (6, True)
    assert (got["e"].days_left, got["e"].expiry_warning) == (7, False)
