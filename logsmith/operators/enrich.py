"""Project enrichment and key validation (J1, J2), last-write-wins key dedupe (A13) and
selection by id set (J3).

Ingest rows are classified by ONE left join against the deduplicated project table:
a row is accepted when its key exists and has not expired at receive time, and otherwise
gets a rejection reason (missing / unknown / expired key, then malformed body). Accepted
and rejected outputs are two filters of the same join. Rows without a key match nothing and
are spread by their own id, so they never meet in one task. AQE broadcasts the project side
when its measured size allows and splits a hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsmith.schema import LOGS_SCHEMA
from logsmith.sources.ingest import explode_batches, log_entry_columns, parse_envelopes, parse_records, stamp_ms

# Rejection reasons, in the order they are checked.
REJECT_REASONS = ("missing_key", "unknown_key", "expired_key", "malformed")


def dedupe_keys(projects: DataFrame) -> DataFrame:
    """One row per ``api_key`` — the latest by ``(created_at, id)``. A partial/final
    aggregate (``max`` of a struct, sort-based), so duplicates of one key combine map-side."""
    latest = F.max(F.struct("created_at", "id", "name", "expires_at")).alias("_last")
    return projects.groupBy("api_key").agg(latest).select(
        F.col("_last.id").alias("id"),
        F.col("_last.name").alias("name"),
        "api_key",
        F.col("_last.created_at").alias("created_at"),
        F.col("_last.expires_at").alias("expires_at"),
    )


def key_lookup(projects: DataFrame) -> DataFrame:
    """Deduplicated key -> project side of the enrichment join."""
    return dedupe_keys(projects).select(
        F.col("api_key").alias("_pkey"),
        F.col("id").alias("project_id"),
        F.col("name").alias("project_name"),
        F.col("expires_at").alias("_expires"),
    )


def key_intervals(history: DataFrame) -> DataFrame:
    """Which project a key belonged to, and when: a row per version of a key (``created_at`` is
    when it was registered, renamed or given another expiry; of versions of one time the last id
    counts) with the span ``_from <= t < _to`` in which it was the latest. A key's versions are
    few, so a window over them is."""
    one = history.groupBy("api_key", "created_at").agg(F.max(F.struct("id", "name", "expires_at")).alias("_v"))
    following = F.lead("created_at").over(Window.partitionBy("api_key").orderBy("created_at"))
    return one.select(
        F.col("api_key").alias("_pkey"),
        F.col("_v.id").alias("project_id"),
        F.col("_v.name").alias("project_name"),
        F.col("_v.expires_at").alias("_expires"),
        F.col("created_at").alias("_from"),
        following.alias("_to"),
    )


def classify_as_of(records: DataFrame, history: DataFrame, key: str = "api_key", at: str = "received_at",
                   id_col: str = "raw_id") -> DataFrame:
    """J1/J2 as of the receive time: a record meets the version of its key that was valid when it
    was received, so a replay after a rename, a new expiry or another registration classifies it
    as the first run did. A key without a version by then is unknown. Versions added later with
    a later ``created_at`` change nothing for earlier records."""
    p = key_intervals(history).where(F.coalesce(F.col("_pkey"), F.lit("")) != "")
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    join_key = F.when(blank, F.concat(F.lit("\u0000"), F.col(id_col).cast("string"))).otherwise(F.col(key))
    valid = (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return _reasons(records.join(p, (join_key == F.col("_pkey")) & valid, "left"), blank, at).drop("_from", "_to")


def _reasons(joined: DataFrame, blank: Column, at: str) -> DataFrame:
    reason = (
        F.when(blank, F.lit("missing_key"))
        .when(F.col("_pkey").isNull(), F.lit("unknown_key"))
        .when(F.col("_expires") < F.col(at), F.lit("expired_key"))
        .when(F.col("malformed"), F.lit("malformed"))
    )
    return joined.withColumn("reject_reason", reason).drop("_pkey", "_expires")


def classify(records: DataFrame, projects: DataFrame | None = None, key: str = "api_key", at: str = "received_at",
             lookup: DataFrame | None = None, id_col: str = "raw_id") -> DataFrame:
    """Adds ``project_id``, ``project_name`` and ``reject_reason`` (null = accepted).
    Pass ``lookup`` (from ``key_lookup``) to reuse a project side."""
    p = (lookup if lookup is not None else key_lookup(projects)).where(F.coalesce(F.col("_pkey"), F.lit("")) != "")
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    # a key that no project has, different for each row, in place of a missing one
    join_key = F.when(blank, F.concat(F.lit("\u0000"), F.col(id_col).cast("string"))).otherwise(F.col(key))
    return _reasons(records.join(p, join_key == F.col("_pkey"), "left"), blank, at)


def to_logs(classified: DataFrame, id_col: str = "raw_id", at: str = "received_at",
            client_ip: str = "client_ip") -> DataFrame:
    """Accepted rows in the stored ``logs`` layout."""
    ok = classified.where(F.col("reject_reason").isNull())
    ts = stamp_ms(at)
    cols = log_entry_columns("rec", F.col(client_ip))
    return ok.select(
        F.col(id_col).cast("string").alias("id"),
        ts.alias("timestamp"),
        *cols,
        F.col("project_id"),
        F.col("project_name"),
        ts.alias("created_at"),
    ).select(*[f.name for f in LOGS_SCHEMA.fields])


def rejected(classified: DataFrame, id_col: str = "raw_id", key: str = "api_key") -> DataFrame:
    """J2 quarantine: ``raw_id, api_key, received_at, reason``."""
    return classified.where(F.col("reject_reason").isNotNull()).select(
        F.col(id_col).alias("raw_id"), F.col(key).alias("api_key"), "received_at",
        F.col("reject_reason").alias("reason"),
    )


def ingest_records(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """S4 + J1/J2: classified single-record ingest."""
    return classify(parse_records(raw), projects)


def ingest_records_as_of(raw: DataFrame, history: DataFrame) -> DataFrame:
    """S4 + J1/J2 by the key history at the receive time."""
    return classify_as_of(parse_records(raw), history)


def ingest_batches(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """S5 + J1/J2: classified batch ingest: a row per element of an accepted envelope, one row
    for a rejected envelope (also an empty one)."""
    return explode_batches(classify(parse_envelopes(raw), projects))


def select_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in ``ids`` — a left semi join. The id set is usually derived
    (a selection, another query), so no size is known before it runs: both sides shuffle on
    the id and AQE turns the join into a broadcast only from the measured size of the
    materialised id set (``spark.sql.adaptive.autoBroadcastJoinThreshold``)."""
    keys = ids.select(F.col(id_col).alias("_sel_id"))
    return df.join(keys, F.col(id_col) == F.col("_sel_id"), "left_semi")
