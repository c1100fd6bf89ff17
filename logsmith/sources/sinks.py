"""Sinks: stored tables (S6, S7, S12) and exports.

Stored layout (S12): partitioned by ``month``; within a month, files are range-partitioned
and sorted by ``(app_name, level, timestamp)`` so Parquet row-group min/max statistics skip
data for app / level / time predicates (the role of a clustered key), and
``trace_id`` carries a bloom filter for trace lookups. Range
partitioning samples the keys, so a hot app is split across tasks instead of landing in
one. Appends (streaming micro-batches) only sort within their partitions; ``compact_month``
folds them, with what the stored month already holds, into the clustered layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsmith.functions.time import month_key
from logsmith.schema import APP_LOGS_SCHEMA, LOGS_SCHEMA, LOGS_STORED_SCHEMA, add_missing_columns, LOG_DEFAULTS

CLUSTER_KEYS = ("app_name", "level", "timestamp")
# File sizing of the stored tables.
MAX_RECORDS_PER_FILE = 2_000_000
TARGET_PARTITION_BYTES = 512 * 1024 * 1024


def packed(df: DataFrame) -> DataFrame:
    """Rows dealt by a hash of the whole row into tasks of the size that Spark advises
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): a few rows make one file, and what a
    task sorts does not grow with the rows, whatever the number of shuffle partitions."""
    return df.hint("rebalance", *df.columns)


def with_month(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("month", month_key(ts))


def rewrite_partitions(df: DataFrame) -> int:
    """Output tasks of a full rewrite: the input size over ~512 MB per task (Catalyst's
    size estimate; no job), at least ``spark.sql.shuffle.partitions``."""
    from logsmith.plans.broadcast import estimated_bytes

    floor_n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    est = estimated_bytes(df)
    by_size = -(-est // TARGET_PARTITION_BYTES) if est else 0
    return max(floor_n, int(by_size))


def clustered(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """S12 for a full rewrite: range partitions over (month, app, level, ts), sorted. Range
    bounds come from a sample of the keys, so a hot app is split by timestamp across tasks."""
    df = df if "month" in df.columns else with_month(df)
    keys = ("month",) + CLUSTER_KEYS
    n = partitions or rewrite_partitions(df)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def write_logs(df: DataFrame, path: str, mode: str = "append", rewrite: bool = False,
               partitions: int | None = None) -> None:
    """Write ``logs`` rows (defaults applied, schema order) partitioned by month."""
    rows = add_missing_columns(df, LOGS_SCHEMA, LOG_DEFAULTS)
    rows = with_month(rows).select(*[f.name for f in LOGS_STORED_SCHEMA.fields])
    rows = clustered(rows, partitions) if rewrite else rows.sortWithinPartitions("month", *CLUSTER_KEYS)
    (rows.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     # trace lookups are equality on a high-cardinality key that min/max statistics cannot
     # skip: a bloom filter per row group lets the scan skip row groups without the trace
     # (Parquet writes it once a row group's values overflow the dictionary; below that,
     # dictionary filtering skips the row group instead)
     .option("parquet.bloom.filter.enabled#trace_id", "true")
     .partitionBy("month").parquet(path))


def write_app_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Request-log rows, duration rounded to two decimals, partitioned by month."""
    rows = add_missing_columns(df, APP_LOGS_SCHEMA).withColumn("duration_ms", F.round("duration_ms", 2))
    rows = with_month(rows).sortWithinPartitions("month", "timestamp")
    rows.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("month").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Scan the stored ``logs`` table with its declared schema."""
    return spark.read.schema(LOGS_STORED_SCHEMA).parquet(path)


def read_app_logs(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType(APP_LOGS_SCHEMA.fields + [T.StructField("month", T.IntegerType())])).parquet(path)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    from logsmith.schema import PROJECTS_SCHEMA

    return spark.read.schema(PROJECTS_SCHEMA).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Persist a mutated table to a NEW path (callers switch readers to it afterwards)."""
    df.write.mode("errorifexists").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines (one object per line; splittable, unlike one indented array)."""
    df.write.mode("errorifexists").json(path)


def export_text(lines: DataFrame, path: str, col: str = "line") -> None:
    """S10 writer for pre-formatted lines."""
    lines.select(col).write.mode("errorifexists").text(path)


def export_csv(lines: DataFrame, path: str, header: str, col: str = "line") -> None:
    """S9 writer: every part file starts with the header line, so each is a complete CSV file
    that ``spark.read.csv(header=True)`` reads with the others (embedded newlines are escaped,
    quotes doubled by the line format)."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition
    line = F.when(first, F.concat(F.lit(header + "\n"), F.col(col))).otherwise(F.col(col))
    lines.select(line.alias("line")).write.mode("errorifexists").text(path)


def _write_month(rows: DataFrame, path: str, month: int, cluster: tuple[str, ...], partitions: int | None) -> None:
    n = partitions or rewrite_partitions(rows)
    (rows.repartitionByRange(n, *cluster).sortWithinPartitions(*cluster).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .option("parquet.bloom.filter.enabled#trace_id", "true").partitionBy("month").parquet(path))


def compact_month(spark: SparkSession, landing_path: str, table_path: str, month: int, stage_path: str,
                  app_logs: bool = False, partitions: int | None = None) -> None:
    """Fold one month of the streaming landing sink into the stored table: the rows that the
    table already holds (batch ingest, an earlier compaction) and the landing rows whose id it
    does not hold are staged together and then replace exactly ``month=<month>``. Re-running
    after a failure gives the same month: the landing rows are still there or already stored.
    ``stage_path`` is a new folder for each run. Drop the landing month afterwards."""
    schema, defaults = (APP_LOGS_SCHEMA, None) if app_logs else (LOGS_SCHEMA, LOG_DEFAULTS)
    landing = add_missing_columns(spark.read.parquet(landing_path).where(F.col("month") == month), schema, defaults)
    rows = landing
    if path_exists(spark, f"{table_path}/month={month}"):
        stored = add_missing_columns((read_app_logs if app_logs else read_logs)(spark, table_path).where(F.col("month") == month), schema, defaults)
        rows = stored.unionByName(landing.join(stored.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti"))
    rows.withColumn("month", F.lit(int(month))).write.parquet(stage_path)
    staged = spark.read.parquet(stage_path)
    _write_month(staged, table_path, month, ("timestamp",) if app_logs else CLUSTER_KEYS, partitions)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
