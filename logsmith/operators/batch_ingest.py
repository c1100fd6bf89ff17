"""Batch ingest job: raw records -> stored ``logs`` + quarantine, with lineage cut once.

Accepted and rejected rows are two filters of ONE classification (parse + project join).
Writing both straight from the classification would parse and join the raw input twice,
and a lost executor during the second write would recompute from raw. Instead the
classified rows are written once to a staged table in the shared checkpoint folder, and
both outputs are read from it (narrow scans).

Re-running the job with the same stage path repeats nothing: a completed stage is reused (its
``_SUCCESS`` marker), accepted rows whose id the touched months already hold are left out, and
the quarantine of the job is one partition that is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsmith.functions.time import month_key
from logsmith.operators import enrich
from logsmith.sources.sinks import path_exists, read_logs, write_logs

STAGED_COLUMNS = ("raw_id", "received_at", "api_key", "client_ip", "rec", "malformed", "project_id", "project_name",
                  "reject_reason")


def run_batch_ingest(spark: SparkSession, raw: DataFrame, projects: DataFrame, logs_path: str, rejected_path: str,
                     stage_path: str) -> dict:
    """Classify ``raw`` once into ``stage_path``, append the accepted rows that the stored table
    at ``logs_path`` does not hold yet, and write rejections to the job's partition
    (``job=<name of the stage>``) of ``rejected_path``. Returns the row counts of the stage."""
    if not path_exists(spark, f"{stage_path}/_SUCCESS"):
        classified = enrich.ingest_records(raw, projects)
        classified.select(*STAGED_COLUMNS).write.mode("overwrite").parquet(stage_path)
    staged = spark.read.parquet(stage_path)
    accepted = enrich.to_logs(staged)
    if path_exists(spark, logs_path):
        # only the months of this job; a row per month comes to the driver
        months = [r["m"] for r in accepted.select(month_key("timestamp").alias("m")).distinct().collect()]
        stored = read_logs(spark, logs_path).where(F.col("month").isin(months)).select(F.col("id").alias("_id"))
        accepted = accepted.join(stored, F.col("id") == F.col("_id"), "left_anti")
    write_logs(accepted, logs_path)
    job = stage_path.rstrip("/").rsplit("/", 1)[-1]
    enrich.rejected(staged).write.mode("overwrite").parquet(f"{rejected_path}/job={job}")
    counts = staged.agg(F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
                        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")).first()
    return {"accepted": counts["accepted"], "rejected": counts["rejected"], "stage": stage_path}
