"""Sizes known to the planner. Joins carry no broadcast hint: AQE broadcasts a side when its
measured size is within ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits hot keys
otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Spark reports "unknown" sizes (e.g. data from a local collection) as Long.MaxValue.
UNKNOWN_SIZE = 2 ** 62


def known_size(v) -> int | None:
    """A py4j size (``BigInt`` or number) as int, ``None`` when Spark does not know it."""
    n = int(v if isinstance(v, int) else v.toString())
    return None if n >= UNKNOWN_SIZE else n


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan (no job); ``None`` when unknown."""
    return known_size(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
