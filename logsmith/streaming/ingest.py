"""Streaming ingest.

``readStream`` (file source; any streaming source with the raw schema works) -> stateless
parse -> ``foreachBatch``: the micro-batch is joined with a persisted project lookup that is
re-read from the table once a minute (key changes are picked up within that period, like a
refreshed key cache), each batch gets ONE processing-time stamp taken on the driver (T4), and
the outputs are written below ``batch_id=<id>/``, which a replayed batch overwrites as a whole:
it leaves no duplicates, also when its replay falls into another month. The checkpoint location
makes the source offsets durable. ``sources.sinks.compact_month`` folds the batches of a month
into the stored table, which bounds the number of directories. A table under a manifest takes a
batch in one commit instead, and ``compact`` works beside the stream.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsmith.functions.time import fmt_ts, month_key
from logsmith.operators import enrich, requests
from logsmith.schema import RAW_LOGS_SCHEMA, LOGS_SCHEMA
from logsmith.sources.ingest import explode_batches, parse_envelopes, parse_records
from logsmith.sources.manifest import ManifestTable
from logsmith.sources.sinks import packed

# Micro-batch cadence of the two ingest queues (seconds).
LOG_TRIGGER = "1 second"
APP_LOG_TRIGGER = "2 seconds"


def batch_stamp() -> dt.datetime:
    """Processing time of a micro-batch, UTC, millisecond precision (T4)."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


def read_raw_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                    schema=RAW_LOGS_SCHEMA, max_bytes_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.load(path)


# Fixed value: micro-batches of a drain, about. With few, a batch has files for many tasks.
DRAIN_BATCHES = 8


def drain_trigger(spark: SparkSession, path: str, least: int) -> int:
    """Bytes of a micro-batch when a backlog is drained: ``least``, or a fixed share of what waits
    if that is more. What a micro-batch costs whatever its size (planning, commits, files) is
    paid a bounded number of times then, and a batch has files for many tasks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(least, -(-fs.getContentSummary(p).getLength() // DRAIN_BATCHES))


def write_batch_partitions(df: DataFrame, path: str, batch_id: int, ts_col: str = "timestamp") -> None:
    """Idempotent append: the directory of the batch is overwritten, with months inside. Rows of
    a month sit together, so a batch leaves one file per month and task that has some."""
    (df.withColumn("month", month_key(ts_col)).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("month").parquet(f"{path}/batch_id={int(batch_id)}"))


# The project key table is re-read at most this often (seconds).
PROJECT_REFRESH_SECONDS = 60


class ProjectLookup:
    """Persisted key -> project side for the stream-static join, re-read from
    the project table once it is older than ``refresh_seconds`` (new / expired / renamed keys
    are seen within that period). A lost cached block is recomputed from the table."""

    def __init__(self, loader: Callable[[], DataFrame], refresh_seconds: float = PROJECT_REFRESH_SECONDS):
        self.loader = loader
        self.refresh_seconds = refresh_seconds
        self._df: DataFrame | None = None
        self._loaded = 0.0

    def get(self) -> DataFrame:
        import time

        now = time.monotonic()
        if self._df is None or now - self._loaded >= self.refresh_seconds:
            old = self._df
            self._df = enrich.key_lookup(self.loader()).persist()
            self._loaded = now
            if old is not None:
                old.unpersist()
        return self._df


def log_ingest_batch(projects_loader: Callable[[], DataFrame], logs: str | ManifestTable, rejected: str | ManifestTable,
                     refresh_seconds: float = PROJECT_REFRESH_SECONDS, envelopes: bool = False, writer: str = "ingest"):
    """The ``foreachBatch`` body of T1. Sinks are landing folders or tables under a manifest, which
    take a batch in one commit, once. ``envelopes``: the batch holds parsed batch bodies (S5), each
    of which is accepted with all its records or rejected as a whole."""
    lookup = ProjectLookup(projects_loader, refresh_seconds)

    def write(rows: DataFrame, sink: str | ManifestTable, batch_id: int, ts_col: str) -> None:
        rows = packed(rows)  # the cached join has shuffle partitions, however small the batch
        if isinstance(sink, ManifestTable):
            sink.append(rows, (writer, int(batch_id)))
        else:
            write_batch_partitions(rows, sink, batch_id, ts_col=ts_col)

    def run(batch: DataFrame, batch_id: int) -> None:
        stamp = F.lit(fmt_ts(batch_stamp())).cast("timestamp_ntz")
        classified = enrich.classify(batch.withColumn("_stamp", stamp), lookup=lookup.get())
        classified = (explode_batches(classified) if envelopes else classified).persist()
        try:
            accepted = enrich.to_logs(classified, "entry_id" if envelopes else "raw_id", at="_stamp")
            write(accepted.select(*[f.name for f in LOGS_SCHEMA.fields]), logs, batch_id, "timestamp")
            write(enrich.rejected(classified), rejected, batch_id, "received_at")
        finally:
            classified.unpersist()

    return run


def start_log_ingest(spark: SparkSession, raw_path: str, projects_loader: Callable[[], DataFrame],
                     logs_path: str | ManifestTable, rejected_path: str | ManifestTable, checkpoint: str, fmt: str = "parquet",
                     available_now: bool = False, max_files_per_trigger: int | None = None,
                     max_bytes_per_trigger: int | None = None, envelopes: bool = False):
    """Start the ingest query over single records (S4) or batch bodies (``envelopes``, S5);
    ``available_now`` drains what exists and stops. With tables under a manifest, the checkpoint's
    name is the writer whose batches count once."""
    raw = read_raw_stream(spark, raw_path, fmt, max_files_per_trigger, max_bytes_per_trigger=max_bytes_per_trigger)
    parsed = parse_envelopes(raw) if envelopes else parse_records(raw)
    body = log_ingest_batch(projects_loader, logs_path, rejected_path, envelopes=envelopes, writer=checkpoint)
    w = parsed.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=LOG_TRIGGER)
    return w.start()


# Fixed value: a table that a stream fills is looked at so often until it is compacted (seconds).
LOOK_SECONDS = 0.1


def compact_beside(query: StreamingQuery, table: ManifestTable) -> int:
    """S12 beside T1: compact ``table`` once while ``query`` goes on writing into it, as soon as one
    of its months has several files. Batches that are committed meanwhile stay beside the clustered
    files. A stream that ends before that has left at most its last batches to compact."""
    def several() -> bool:
        return any(n > 1 for n in Counter(f.month for f in table.snapshot().files).values())

    while query.isActive and not several():
        query.awaitTermination(LOOK_SECONDS)
    return table.compact()


def start_request_ingest(spark: SparkSession, requests_stream: DataFrame, app_logs_path: str, checkpoint: str,
                         available_now: bool = False):
    """Request records -> request log (E9-E12, F16) -> ``app_logs`` partitions."""
    logged = requests.request_log(requests_stream)

    def run(batch: DataFrame, batch_id: int) -> None:
        stamp = F.lit(fmt_ts(batch_stamp())).cast("timestamp_ntz")
        write_batch_partitions(batch.withColumn("created_at", stamp), app_logs_path, batch_id)

    w = logged.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=APP_LOG_TRIGGER)
    return w.start()
