"""Retention: delete older than N days (M1), delete all (M2), insert-time TTL (M3), and the
partition rewrite that applies them to a stored table or to the streaming landing sink.

Partitions (``month=`` of the table, ``batch_id=/month=`` of the landing sink) whose rows have
all expired are dropped as directories; those with some expired rows are rewritten: filter ->
a stage of this run in the shared checkpoint folder -> a ``swap pending`` note beside the table
-> dynamic partition overwrite -> note removed. No path is overwritten while it is being read,
and a stage is used only by the run that made it, or by the next one if its swap was pending:
every mutation completes an announced swap first. Tables under a manifest (``sources.manifest``)
have no swap at all.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsmith.functions.time import as_datetime, fmt_ts, month_of, ts_lit
from logsmith.operators.filters import DAYS_RANGE, guard

# Default TTL in days when the configured value is not positive.
DEFAULT_TTL_DAYS = 30


def cutoff(as_of, days: int) -> dt.datetime:
    return as_datetime(as_of) - dt.timedelta(days=days)


def delete_older_than(df: DataFrame, as_of, days: int, col: str = "timestamp") -> DataFrame:
    """M1: keep rows with ``col >= as_of - days``. ``days`` must be in 1..3650 (M2 is
    ``delete_all``; a non-positive ``days`` raises instead of truncating)."""
    days = guard(days, DAYS_RANGE, "days")
    c = cutoff(as_of, days)
    preds = F.col(col) >= ts_lit(c)
    if "month" in df.columns:
        preds = preds & (F.col("month") >= F.lit(month_of(c)))
    return df.where(preds)


def delete_all(df: DataFrame) -> DataFrame:
    """M2: an empty frame of the same schema."""
    return df.where(F.lit(False))


def ttl_expire(df: DataFrame, as_of, ttl_days: int | None = None, col: str = "created_at") -> DataFrame:
    """M3: rows live until ``created_at + ttl_days`` (insert time, not event time)."""
    days = ttl_days if ttl_days and ttl_days > 0 else DEFAULT_TTL_DAYS
    return df.where(F.col(col) > ts_lit(cutoff(as_of, days)))


PENDING = "_retention_pending"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partition_dirs(spark: SparkSession, path: str) -> dict[tuple, str]:
    """``(month,)`` or ``(batch_id, month)`` -> directory of a stored table or landing sink."""
    p, fs = _fs(spark, path)
    out: dict[tuple, str] = {}

    def walk(at, key: tuple) -> None:
        for st in fs.listStatus(at):
            name = st.getPath().getName()
            if st.isDirectory() and name.startswith("month="):
                out[(*key, int(name.split("=", 1)[1]))] = st.getPath().toString()
            elif st.isDirectory() and name.startswith("batch_id="):
                walk(st.getPath(), (int(name.split("=", 1)[1]),))

    if fs.exists(p):
        walk(p, ())
    return out


def month_dirs(spark: SparkSession, path: str) -> dict[int, str]:
    """``month=yyyymm`` partition directories of a stored table."""
    return {key[0]: d for key, d in partition_dirs(spark, path).items() if len(key) == 1}


def _drop(spark: SparkSession, directory: str) -> None:
    p, fs = _fs(spark, directory)
    fs.delete(p, True)


def delete_all_stored(spark: SparkSession, path: str) -> int:
    """M2 on a stored table: every partition goes, the table stays (empty). Returns how many."""
    _drop(spark, f"{path}/{PENDING}")  # an announced swap must not bring rows back
    dirs = partition_dirs(spark, path)
    for d in dirs.values():
        _drop(spark, d)
    return len(dirs)


def _pending(spark: SparkSession, path: str) -> str | None:
    """The note of a swap that a run has announced and not finished: its stage and, on further
    lines, the condition that it keeps rows by and the partitions that it rewrites."""
    p, fs = _fs(spark, f"{path}/{PENDING}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _note(spark: SparkSession, path: str, stage: str, keep: str = "true", edges: list[tuple] = ()) -> None:
    p, fs = _fs(spark, f"{path}/{PENDING}")
    out = fs.create(p, True)
    out.write(bytearray("\n".join([stage, keep, json.dumps(list(edges))]).encode()))
    out.close()


def _rows_of(spark: SparkSession, path: str, edges: list[tuple]) -> DataFrame:
    names = ["batch_id", "month"][-len(edges[0]):]
    here = F.struct(*(F.col(n).cast("bigint") for n in names))
    return spark.read.parquet(path).where(here.isin([F.struct(*(F.lit(v).cast("bigint") for v in e)) for e in edges]))


def _swap(spark: SparkSession, path: str, rows: DataFrame, keep: str, edges: list[tuple], stage_root: str) -> tuple[list, list]:
    """Put ``rows`` in the place of the partitions ``edges``, through a new stage."""
    names = ["batch_id", "month"][-len(edges[0]):]
    stage = f"{stage_root}/{uuid.uuid4().hex}"
    rows.write.partitionBy(*names).parquet(stage)
    left = sorted(partition_dirs(spark, stage))
    _note(spark, path, stage, keep, edges)
    if left:
        (spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*names).parquet(path))
    dirs = partition_dirs(spark, path)
    empty = [e for e in edges if e not in left]
    for e in empty:
        if e in dirs:
            _drop(spark, dirs[e])
    _drop(spark, f"{path}/{PENDING}")
    return left, empty


def finish_pending(spark: SparkSession, path: str, stage_root: str) -> None:
    """Complete an announced swap for its own partitions, by its own condition: what its stage
    kept, and of what stands in these partitions now the rows that the stage does not hold and
    that pass the condition (they have arrived since). Every mutation starts with it."""
    if (note := _pending(spark, path)) is None:
        return
    stage, keep, edges = (note.split("\n") + ["true", "[]"])[:3]
    kept = partition_dirs(spark, stage)
    edges = sorted({tuple(e) for e in json.loads(edges)} | set(kept))
    here = [e for e in edges if e in partition_dirs(spark, path)]
    names = ["batch_id", "month"][-len(edges[0]):]
    old = spark.read.parquet(stage) if kept else None
    if here:
        now = _rows_of(spark, path, here).where(keep)
        if old is not None:
            ids = old.select(F.col("id").alias("_id"), *(F.col(n).alias(f"_{n}") for n in names))
            same = [F.col("id") == F.col("_id"), *(F.col(n) == F.col(f"_{n}") for n in names)]
            now = old.unionByName(now.join(ids, same, "left_anti"), allowMissingColumns=True)
        old = now
    if old is not None:
        _swap(spark, path, old, keep, edges, stage_root)
    else:
        _drop(spark, f"{path}/{PENDING}")


def _rewrite(spark: SparkSession, path: str, keep: str, edges: list[tuple], stage_root: str) -> tuple[list, list]:
    """Keep the rows of the partitions ``edges`` that pass ``keep``; returns the partitions that
    were rewritten and those that became empty."""
    return _swap(spark, path, _rows_of(spark, path, edges).where(keep), keep, edges, stage_root)


def apply_retention(spark: SparkSession, path: str, as_of, days: int, stage_path: str) -> dict:
    """M1 on a stored table or a landing sink: drop months wholly before the cutoff and rewrite
    the partitions of the month that straddles it through a new folder under ``stage_path``.
    Safe to repeat and to restart: rows that arrived since are kept."""
    days = guard(days, DAYS_RANGE, "days")
    c = cutoff(as_of, days)
    edge = month_of(c)
    finish_pending(spark, path, stage_path)
    dirs = partition_dirs(spark, path)
    dropped = sorted(k for k in dirs if k[-1] < edge)
    for k in dropped:
        _drop(spark, dirs[k])
    edges = sorted(k for k in dirs if k[-1] == edge)
    rewritten: list = []
    if edges:
        rewritten, empty = _rewrite(spark, path, f"timestamp >= TIMESTAMP_NTZ'{fmt_ts(c)}'", edges, stage_path)
        dropped += empty
    plain = lambda keys: [k[0] if len(k) == 1 else k for k in keys]
    return {"dropped_months": plain(dropped), "rewritten_months": plain(rewritten), "cutoff": c}


def apply_ttl(spark: SparkSession, path: str, as_of, stage_path: str, ttl_days: int | None = None,
              col: str = "created_at") -> dict:
    """M3 on a stored table (``logs`` or ``app_logs``): rows whose ``col`` has passed its TTL go.
    A month is judged by its own rows, since insert time and event time differ: a row per
    partition with its expired rows and its rows comes to the driver."""
    days = ttl_days if ttl_days and ttl_days > 0 else DEFAULT_TTL_DAYS
    keep = f"{col} > TIMESTAMP_NTZ'{fmt_ts(cutoff(as_of, days))}'"
    finish_pending(spark, path, stage_path)
    dirs = partition_dirs(spark, path)
    if not dirs:
        return {"dropped_months": [], "rewritten_months": []}
    names = ["batch_id", "month"][-len(next(iter(dirs))):]
    counts = spark.read.parquet(path).groupBy(*names).agg(F.expr(f"count_if(not coalesce({keep}, false))").alias("old"), F.count(F.lit(1)).alias("n")).collect()
    whole = [tuple(r[n] for n in names) for r in counts if r["old"] == r["n"]]
    some = sorted(tuple(r[n] for n in names) for r in counts if 0 < r["old"] < r["n"])
    for k in whole:
        _drop(spark, dirs[k])
    rewritten, empty = _rewrite(spark, path, keep, some, stage_path) if some else ([], [])
    return {"dropped_months": sorted(whole) + empty, "rewritten_months": rewritten}
