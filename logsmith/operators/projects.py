"""Project table: listing with key mask and expiry status (K7, E14, E15) and the
mutations rename / delete / insert (M4-M6).

Mutations are DataFrame transforms; ``sinks.write_table`` persists the result to a new
path (never over the path being read).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsmith.functions.display import expiry_status
from logsmith.functions.text import mask_key
from logsmith.functions.time import as_datetime
from logsmith.schema import PROJECTS_SCHEMA


def project_status(projects: DataFrame, as_of) -> DataFrame:
    """K7: projects by creation time with masked key and expiry columns."""
    st = expiry_status("expires_at", as_of)
    return projects.select(
        "id",
        "name",
        mask_key("api_key").alias("masked_key"),
        "created_at",
        "expires_at",
        st["status"].alias("status"),
        st["days_left"].alias("days_left"),
        st["expiry_warning"].alias("expiry_warning"),
        st["expiry_label"].alias("expiry_label"),
    ).orderBy("created_at", "id")


def rename_project(projects: DataFrame, project_id: str, new_name: str) -> DataFrame:
    """M4: rename one project; stored log rows keep the name they were written with."""
    return projects.withColumn("name", F.when(F.col("id") == project_id, F.lit(new_name)).otherwise(F.col("name")))


def delete_project(projects: DataFrame, project_id: str) -> DataFrame:
    """M5: remove one project; its log rows stay."""
    return projects.where(F.col("id") != project_id)


def new_project(spark: SparkSession, project_id: str, name: str, api_key: str, as_of,
                expiry_days: int | None = None) -> DataFrame:
    """M6: one project row; expires ``expiry_days`` after ``as_of`` when positive, else never."""
    created = as_datetime(as_of)
    expires = created + dt.timedelta(days=expiry_days) if expiry_days and expiry_days > 0 else None
    return spark.createDataFrame([(project_id, name, api_key, created, expires)], PROJECTS_SCHEMA)


def insert_project(spark: SparkSession, projects: DataFrame, project_id: str, name: str, api_key: str, as_of,
                   expiry_days: int | None = None) -> DataFrame:
    return projects.unionByName(new_project(spark, project_id, name, api_key, as_of, expiry_days))
