"""Live tail. The log filter is applied to each micro-batch, and the sink holds the newest N
matching rows: they and the batch's newest N are merged into the next version, a folder of its
own (the newest finished version counts, older ones are removed). Reading it never scans more
than N rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsmith.operators.filters import LogFilter, conjunction, filter_logs
from logsmith.operators.retention import _drop, _fs
from logsmith.operators.search import newest_first
from logsmith.plans.topk import group_limit_threshold, ordered_page

# Rows kept by the tail view and its refresh period.
TAIL_ROWS = 100
TAIL_TRIGGER = "2 seconds"


def tail_stream(logs_stream: DataFrame, f: LogFilter | None) -> DataFrame:
    """Stateless filtered stream (append mode)."""
    return filter_logs(logs_stream, f)


def _versions(spark: SparkSession, sink_path: str) -> list[int]:
    """Finished versions (batch ids) of a tail sink, oldest first."""
    p, fs = _fs(spark, sink_path)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    ids = [int(n.split("-", 1)[1]) for n in names if n.startswith("version-")]
    done = lambda i: (lambda q, f: f.exists(q))(*_fs(spark, f"{sink_path}/version-{i}/_SUCCESS"))
    return sorted(i for i in ids if done(i))


def _merge(spark: SparkSession, sink_path: str, batch_id: int, top: DataFrame, newest_of) -> None:
    """The next version of a sink: the batch's newest rows and the version before it."""
    before = [v for v in _versions(spark, sink_path) if v < batch_id]  # a replay starts from the same version
    if before:
        top = newest_of(top.unionByName(spark.read.schema(top.schema).parquet(f"{sink_path}/version-{before[-1]}")))
    top.coalesce(1).write.mode("overwrite").parquet(f"{sink_path}/version-{int(batch_id)}")
    for v in before[:-1]:  # the last one stays for readers that have just opened it
        _drop(spark, f"{sink_path}/version-{v}")


def _started(rows: DataFrame, run, checkpoint: str, available_now: bool):
    w = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TAIL_TRIGGER)
    return w.start()


def start_tail(spark: SparkSession, logs_stream: DataFrame, f: LogFilter | None, sink_path: str, checkpoint: str,
               available_now: bool = False, rows: int = TAIL_ROWS):
    def run(batch: DataFrame, batch_id: int) -> None:
        newest_of = lambda df: df.orderBy(*newest_first()).limit(rows)
        _merge(spark, sink_path, batch_id, ordered_page(batch, newest_first(), 0, rows), newest_of)

    return _started(tail_stream(logs_stream, f), run, checkpoint, available_now)


def newest_of_each(logs: DataFrame, filters: dict[str, LogFilter], rows: int = TAIL_ROWS) -> DataFrame:
    """The newest ``rows`` of each of many tails in one pass: a row is tested against every filter
    and goes on once for each that it passes (``tail``), and every task keeps the newest of each
    tail before the shuffle. ``rows`` is at most Spark's limit for that step."""
    if not 0 < rows <= group_limit_threshold(logs):
        raise ValueError(f"rows must be from 1 to {group_limit_threshold(logs)}")
    passed = [F.when(conjunction(f.predicates(logs)), F.lit(name)) for name, f in filters.items()]
    met = logs.withColumn("tail", F.explode(F.array_compact(F.array(*passed)))) if passed else logs.limit(0).withColumn("tail", F.lit(""))
    return _newest_each(met, rows)


def _newest_each(met: DataFrame, rows: int) -> DataFrame:
    order = Window.partitionBy("tail").orderBy(*newest_first())
    return met.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= rows).drop("_rn")


def start_tails(spark: SparkSession, logs_stream: DataFrame, filters: dict[str, LogFilter], sink_path: str, checkpoint: str,
                available_now: bool = False, rows: int = TAIL_ROWS):
    """Many live tails (one per viewer) from one scan of each micro-batch: the sink holds the
    newest ``rows`` of each (column ``tail``)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        _merge(spark, sink_path, batch_id, newest_of_each(batch, filters, rows), lambda df: _newest_each(df, rows))

    return _started(logs_stream, run, checkpoint, available_now)


def read_tail(spark: SparkSession, sink_path: str, schema) -> DataFrame:
    """The rows of the newest finished version (none yet: no rows)."""
    done = _versions(spark, sink_path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{sink_path}/version-{done[-1]}")


def newest(sink: DataFrame, n: int = TAIL_ROWS) -> DataFrame:
    """The tail view: newest ``n`` rows of the tail sink (it holds no more than it keeps)."""
    return sink.orderBy(*newest_first()).limit(n).select(*[F.col(c) for c in sink.columns])
