"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsmith.session import checkpoint_root, scratch_path

#: Words of the counting contracts: runs without ASCII space, tab, LF, VT, FF, CR. On UTF-8
#: bytes this is exactly what ``bytes.split()`` yields.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that Python gets, where the session leaves Spark's default: whole texts are
#: long, and a batch and what is made of it have to fit a worker several times.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per context), for clusters and working folders
    where it is not installed, and keep batches of whole texts small."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    sc = spark.sparkContext
    if not getattr(sc, "_logsmith_shipped", False):
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='logsmith-')}/logsmith", "zip", root, "logsmith")
        sc.addPyFile(archive)
        sc._logsmith_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, ...)`` with the package on the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship_package(spark)
        return query(spark, *args)

    return run


def utf8(col: Column | str) -> Column:
    """A text column as UTF-8 bytes, null as the empty string (no decoding in Python)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit(b""))


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's ``spark.checkpoint.dir``, or the local
    fallback of tests."""
    root = checkpoint_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the lineage with
    files that survive the loss of any executor."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_bytes(texts: Iterable, most: int) -> Iterator[list]:
    """Group a stream of texts (or byte strings) into lists of at most ``most`` UTF-8 bytes each;
    a longer one comes alone."""
    group: list = []
    held = 0
    for t in texts:
        n = 0 if t is None else len(t) if isinstance(t, bytes) or t.isascii() else len(t.encode())
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(t)
        held += n
    if group:
        yield group
