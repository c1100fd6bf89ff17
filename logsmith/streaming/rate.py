"""T5 on a stream: the fixed-window rate audit without state.

Each micro-batch writes additive rows into its own ``batch_id`` partition: requests per window
and second, and per distinct arrival time within the seconds that can hold request N+1 of this
batch alone or any earlier request. Reading adds them up. A request may arrive any time late:
its batch adds to the window it belongs to, there is no watermark and nothing is dropped. A
replayed batch overwrites its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsmith.operators.requests import _audit_columns, _limits, _policy, _second, window_start


def batch_counts(batch: DataFrame, policy: str = "login", ts: str = "timestamp", permit: int | None = None,
                 window_minutes: int | None = None) -> DataFrame:
    """Additive rows of a micro-batch: ``window_start, arrived_at, requests``. Arrivals up to the
    second that holds the (N+1)-th of the batch keep their time (a request that is later than N
    others of its own batch is later than N of the window); the rest of a window is one row
    without a time. Requests are counted per second first, and per arrival time only up to the
    limit second."""
    permit, minutes = _policy(policy, permit, window_minutes)
    b = batch.select(window_start(ts, minutes).alias("window_start"), F.col(ts).alias("_ts"))
    limits = _limits(b, permit).select(F.col("window_start").alias("_w"), "_limit_s")
    placed = b.join(limits, F.col("window_start") == F.col("_w"))
    timed = F.col("_limit_s").isNull() | (_second("_ts") <= F.col("_limit_s"))
    return placed.groupBy("window_start", F.when(timed, F.col("_ts")).alias("arrived_at")).agg(F.count(F.lit(1)).alias("requests"))


def start_rate_audit(spark: SparkSession, requests_stream: DataFrame, sink_path: str, checkpoint: str,
                     policy: str = "login", available_now: bool = False, permit: int | None = None,
                     window_minutes: int | None = None):
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch_counts(batch, policy, permit=permit, window_minutes=window_minutes)
        rows.write.mode("overwrite").parquet(f"{sink_path}/batch_id={int(batch_id)}")

    w = requests_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def audit(sink: DataFrame, policy: str = "login", permit: int | None = None, window_minutes: int | None = None) -> DataFrame:
    """The rate audit over all micro-batches so far: the columns of the batch audit. Seconds are
    summed first; only the arrivals of a window's limit second are put in order."""
    permit, minutes = _policy(policy, permit, window_minutes)
    timed = sink.where(F.col("arrived_at").isNotNull())
    per = timed.groupBy("window_start", _second("arrived_at").alias("_s")).agg(F.sum("requests").alias("_n"))
    earlier = Window.partitionBy("window_start").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    running = per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
    limit = running.where((F.col("_before") <= permit) & (F.col("_before") + F.col("_n") > permit)).select(
        F.col("window_start").alias("_w"), F.col("_s").alias("_limit_s"), (F.lit(permit) + 1 - F.col("_before")).alias("_k"))
    at = timed.join(limit, (F.col("window_start") == F.col("_w")) & (_second("arrived_at") == F.col("_limit_s")))
    at = at.groupBy("window_start", "_k", "arrived_at").agg(F.sum("requests").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("window_start").orderBy("arrived_at"))
    first = at.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_k")).groupBy("window_start").agg(
        F.min("arrived_at").alias("first_rejected_at"))
    total = sink.groupBy("window_start").agg(F.sum("requests").alias("requests"))
    return _audit_columns(total.join(first, "window_start", "left"), permit, minutes)


def counts(sink: DataFrame, policy: str = "login", permit: int | None = None, window_minutes: int | None = None) -> DataFrame:
    """Requests per window with permitted / rejected: a sum per window, no arrival is looked at."""
    permit, minutes = _policy(policy, permit, window_minutes)
    total = sink.groupBy("window_start").agg(F.sum("requests").alias("requests"))
    never = F.lit(None).cast("timestamp_ntz").alias("first_rejected_at")
    return _audit_columns(total.select("*", never), permit, minutes).drop("first_rejected_at")
