"""Tables under a manifest (S6, S7, S12, M1-M3, compaction): a versioned list of live files.

Data files are written once, below ``data/commit=<id>/month=<yyyymm>/``, and never changed or
moved. A version of the table is one small file that says which data files joined and which
left; it comes into being by one rename that fails if the version exists. So a mutation has
either happened or not: a job that dies before its commit leaves files that no version names,
and nothing has to be finished or undone by the next one. A commit states the version that it
has read; if others came meanwhile it is put on top of them, unless a file that it removes has
left already (``Conflict``: the caller reads again and repeats).

Readers take one version and see each row once, whatever is being written, compacted or deleted.
Every file is listed with the span of its timestamps and insert times, so scans by time, deletes
by age and TTL open only the files that they concern.

A writer that may be repeated names its ``step`` (writer, number): a step up to the last one
committed by that writer changes nothing.

The rename has to be atomic and to refuse an existing name, as on HDFS; on a local disk, where
Hadoop's rename may replace a version that has just come, a hard link does it.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsmith.functions.time import as_datetime, month_key, ts_lit
from logsmith.plans.broadcast import estimated_bytes
from logsmith.schema import APP_LOGS_SCHEMA, LOG_DEFAULTS, LOGS_SCHEMA, add_missing_columns
from logsmith.sources.file_index import FileIndex, files_holding, write_index
from logsmith.sources.sinks import CLUSTER_KEYS, MAX_RECORDS_PER_FILE, packed

# A version with the whole list every so many versions; attempts of a mutation
# that meets others; versions that stay readable and the age of files no version names.
WHOLE_EVERY = 20
ATTEMPTS = 5
KEEP_VERSIONS = 20
ORPHAN_SECONDS = 24 * 3600
# Fixed value: stored bytes that one task of a rewrite sorts (about eleven times as much in memory)
# and writes into a file of each month.
SORT_BYTES = 32 * 1024 * 1024

_BEGINNING = "0001-01-01 00:00:00"  # rows without an insert time are as old as can be


class Conflict(RuntimeError):
    """A file that the commit removes has left the table since it was read."""


@dataclass(frozen=True)
class DataFile:
    path: str  # below data/
    month: int
    rows: int
    bytes: int
    first: str  # span of the timestamps
    last: str
    oldest: str  # span of the insert times
    newest: str


@dataclass(frozen=True)
class Snapshot:
    version: int  # 0: nothing committed yet
    files: tuple[DataFile, ...]
    steps: dict[str, int]

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)


class ManifestTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = LOGS_SCHEMA, defaults: dict | None = None,
                 ts: str = "timestamp", inserted: str = "created_at", cluster: tuple[str, ...] = CLUSTER_KEYS,
                 indexes: tuple[FileIndex, ...] = ()):
        self.spark, self.path, self.schema, self.defaults = spark, path.rstrip("/"), schema, defaults
        self.ts, self.inserted, self.cluster, self.indexes = ts, inserted, cluster, indexes

    # ---------------------------------------------------------------- the versions

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.makeQualified(p), fs

    def _list(self, path: str) -> list:
        p, fs = self._fs(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _version_path(self, version: int) -> str:
        return f"{self.path}/_manifest/{version:020d}.json"

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list(f"{self.path}/_manifest")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _load(self, version: int) -> dict:
        p, fs = self._fs(self._version_path(version))
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an earlier one."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        elif version and version not in known:
            raise ValueError(f"no version {version}")
        changes = []
        for v in range(version, 0, -1):
            changes.append(self._load(v))
            if changes[-1]["whole"]:
                break
        files: dict[str, DataFile] = {}
        steps: dict[str, int] = {}
        for change in reversed(changes):
            for path in change["remove"]:
                del files[path]
            files.update((f["path"], DataFile(**f)) for f in change["add"])
            steps.update(change["steps"])
        return Snapshot(version, tuple(files.values()), steps)

    def _publish(self, version: int, content: dict) -> bool:
        """Make ``version`` by renaming a finished file; false if the version exists."""
        sc = self.spark.sparkContext
        target, fs = self._fs(self._version_path(version))
        draft, _ = self._fs(f"{self.path}/_manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.getUri().getScheme() == "file":  # Hadoop's rename there looks first and renames then
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(draft, False)
        hadoop = sc._jvm.org.apache.hadoop.fs
        mode = getattr(hadoop, "Options$Rename")
        refuse = sc._gateway.new_array(mode, 1)
        refuse[0] = mode.NONE
        files = hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(draft, target, refuse)
            return True
        except Exception:  # noqa: BLE001 - the one expected failure is told by what exists now
            if not fs.exists(target):
                raise
            fs.delete(draft, False)
            return False

    def commit(self, read: Snapshot, add: list[DataFile], remove: list[DataFile], step: tuple[str, int] | None = None) -> int:
        """Add a version on top of the newest: ``read`` is the one that the change was made from."""
        gone = [f.path for f in remove]
        while True:
            now = read if read.version == max(self.versions(), default=0) else self.snapshot()
            if step and now.steps.get(step[0], -1) >= step[1]:
                return now.version  # this step has been committed
            live = {f.path for f in now.files}
            if missing := [p for p in gone if p not in live]:
                raise Conflict(f"{len(missing)} files have left since version {read.version}")
            version, steps = now.version + 1, {step[0]: step[1]} if step else {}
            whole = version % WHOLE_EVERY == 0
            if whole:
                left = set(gone)
                kept = [f for f in now.files if f.path not in left]
                content = {"whole": True, "add": [asdict(f) for f in [*kept, *add]], "remove": [], "steps": now.steps | steps}
            else:
                content = {"whole": False, "add": [asdict(f) for f in add], "remove": gone, "steps": steps}
            if self._publish(version, content):
                return version
            read = replace(read, version=-1)  # another writer was first: read again

    # ---------------------------------------------------------------- reading

    @property
    def stored_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("month", T.IntegerType())])

    def scan(self, files: list[DataFile]) -> DataFrame:
        """The rows of some files, with their declared schema."""
        if not files:
            return self.spark.createDataFrame([], self.stored_schema)
        schema = T.StructType([*self.stored_schema.fields, T.StructField("commit", T.StringType())])
        base = f"{self.path}/data"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{f.path}" for f in files))
        return rows.drop("commit")

    def read(self, snapshot: Snapshot | None = None, time_from=None, time_to=None) -> DataFrame:
        """One version of the table; with bounds, of the files whose timestamps reach into them
        (rows outside are in these files, too: filter as usual)."""
        low, high = (_text(as_datetime(t)) if t is not None else None for t in (time_from, time_to))
        files = [
            f for f in (snapshot or self.snapshot()).files if (low is None or f.last >= low) and (high is None or f.first <= high)
        ]
        return self.scan(files)

    def read_holding(self, index: FileIndex, texts: list[str], snapshot: Snapshot | None = None) -> DataFrame:
        """The rows of the files that can hold all of ``texts`` (F17, F4; filter as usual)."""
        return self.scan(files_holding(self, snapshot or self.snapshot(), index, texts))

    # ---------------------------------------------------------------- writing

    def write_files(self, rows: DataFrame, clustered: int = 0, spread: bool = False) -> list[DataFile]:
        """Write rows into new files that no version names yet. ``clustered``: range-partitioned
        by month and the cluster keys into so many tasks, or more by the bytes that are read; else
        each task sorts its own rows. ``spread``: for a load of any size, dealt by a hash first, so
        that what a task sorts does not grow with the rows, however few the splits of its input."""
        by_size = -(-(estimated_bytes(rows) or 0) // SORT_BYTES) if clustered else 0
        rows = add_missing_columns(rows, self.schema, self.defaults).withColumn("month", month_key(self.ts))
        keys = ("month", *self.cluster)
        if clustered:
            rows = rows.repartitionByRange(max(clustered, by_size), *keys)
        elif spread:
            rows = packed(rows)
        commit = uuid.uuid4().hex
        target = f"{self.path}/data/commit={commit}"
        (rows.sortWithinPartitions(*keys).write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .option("parquet.bloom.filter.enabled#trace_id", "true").partitionBy("month").parquet(target))
        return self._described(target, commit)

    def _described(self, target: str, commit: str) -> list[DataFile]:
        """A row per written file: from two columns of what was just written."""
        found = [s for s in self._list(target) if s.getPath().getName().startswith("month=")]
        if not found:
            return []
        inserted = F.coalesce(F.col(self.inserted), F.lit(_BEGINNING).cast("timestamp_ntz"))
        rows = self.spark.read.schema(self.stored_schema).option("basePath", target).parquet(*(s.getPath().toString() for s in found))
        for index in self.indexes:
            write_index(rows, index, self.path, commit)
        files = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), "month").agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(self.ts).alias("first"), F.max(self.ts).alias("last"), F.min(inserted).alias("oldest"), F.max(inserted).alias("newest"),
        )
        below, spans = f"commit={commit}/", ("first", "last", "oldest", "newest")
        return [
            DataFile(**(r.asDict() | {"path": below + r["path"].split(below, 1)[1]} | {c: _text(r[c]) for c in spans}))
            for r in files.collect()
        ]

    def append(self, rows: DataFrame, step: tuple[str, int] | None = None, spread: bool = False) -> int:
        """Add rows; returns the version that holds them. ``spread`` as in ``write_files``."""
        read = self.snapshot()
        if step and read.steps.get(step[0], -1) >= step[1]:
            return read.version
        return self.commit(read, self.write_files(rows, spread=spread), [], step)

    def _repeated(self, change: Callable[[Snapshot], int]) -> int:
        for left in range(ATTEMPTS, 0, -1):
            try:
                return change(self.snapshot())
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def keep_where(self, keep: Column, whole: Callable[[DataFile], bool], some: Callable[[DataFile], bool]) -> int:
        """Delete the rows that do not pass ``keep``: files that are ``whole`` beyond it leave
        unread, those that hold ``some`` rows beyond it are replaced, all others stay."""

        def change(read: Snapshot) -> int:
            out = [f for f in read.files if whole(f)]
            mixed = [f for f in read.files if some(f) and not whole(f)]
            if not out and not mixed:
                return read.version
            added = self.write_files(self.scan(mixed).where(keep), _tasks(mixed)) if mixed else []
            return self.commit(read, added, out + mixed)

        return self._repeated(change)

    def delete_older_than(self, as_of, days: int) -> int:
        """M1: rows with ``timestamp >= as_of - days`` stay (``days`` in 1..3650)."""
        from logsmith.operators.filters import DAYS_RANGE, guard

        edge = as_datetime(as_of) - dt.timedelta(days=guard(days, DAYS_RANGE, "days"))
        at = _text(edge)
        return self.keep_where(F.col(self.ts) >= ts_lit(edge), lambda f: f.last < at, lambda f: f.first < at)

    def expire(self, as_of, ttl_days: int | None = None) -> int:
        """M3: rows live until ``created_at + ttl_days``; rows without an insert time go."""
        from logsmith.operators.retention import DEFAULT_TTL_DAYS

        edge = as_datetime(as_of) - dt.timedelta(days=ttl_days if ttl_days and ttl_days > 0 else DEFAULT_TTL_DAYS)
        at = _text(edge)
        return self.keep_where(F.col(self.inserted) > ts_lit(edge), lambda f: f.newest <= at, lambda f: f.oldest <= at)

    def delete_all(self) -> int:
        """M2: what is in the table leaves it; rows that are being appended join afterwards."""
        return self._repeated(lambda read: self.commit(read, [], list(read.files)) if read.files else read.version)

    def compact(self, month: int | None = None, files_over: int = 1) -> int:
        """The files of each month (or of one) that has more than ``files_over`` become
        clustered ones. Files that arrive meanwhile stay beside them."""

        def change(read: Snapshot) -> int:
            by_month: dict[int, list[DataFile]] = {}
            for f in read.files:
                by_month.setdefault(f.month, []).append(f)
            loose = [f for m, fs in by_month.items() if len(fs) > files_over and month in (None, m) for f in fs]
            return self.commit(read, self.write_files(self.scan(loose), _tasks(loose)), loose) if loose else read.version

        return self._repeated(change)

    def vacuum(self, keep_versions: int = KEEP_VERSIONS, orphan_seconds: float = ORPHAN_SECONDS) -> int:
        """Remove files that none of the last ``keep_versions`` versions names and that are older
        than ``orphan_seconds`` (younger ones may belong to a commit under way), and versions
        before these that no kept version builds on. Returns the number of data files."""
        known = self.versions()
        kept = known[-keep_versions:]
        named = {f.path for v in kept for f in self.snapshot(v).files}
        before, removed = (time.time() - orphan_seconds) * 1000, 0
        for commit in self._list(f"{self.path}/data"):
            for part in self._list(commit.getPath().toString()):
                for file in self._list(part.getPath().toString()) if part.isDirectory() else [part]:
                    path = file.getPath()
                    below = path.toString().rsplit("/data/", 1)[1] if part.isDirectory() else None
                    if below not in named and file.getModificationTime() < before:
                        self._fs(path.toString())[1].delete(path, False)
                        removed += below is not None
        commits = {path.split("/", 1)[0] for path in named}
        for index in self._list(f"{self.path}/index"):
            for commit in self._list(index.getPath().toString()):
                if commit.getPath().getName() not in commits and commit.getModificationTime() < before:
                    self._fs(commit.getPath().toString())[1].delete(commit.getPath(), True)
        base = max((v for v in known if v <= (kept[0] if kept else 0) and self._load(v)["whole"]), default=0)
        for v in known:
            if v < base:
                p, fs = self._fs(self._version_path(v))
                fs.delete(p, False)
        return removed


def _tasks(files: list[DataFile]) -> int:
    return max(1, -(-sum(f.bytes for f in files) // SORT_BYTES))


def _text(t: dt.datetime) -> str:
    """As the spans of the files are written: in the order of time."""
    return t.isoformat(sep=" ", timespec="microseconds")


def logs_table(spark: SparkSession, path: str, indexes: tuple[FileIndex, ...] = ()) -> ManifestTable:
    return ManifestTable(spark, path, LOGS_SCHEMA, LOG_DEFAULTS, indexes=indexes)


def app_logs_table(spark: SparkSession, path: str) -> ManifestTable:
    return ManifestTable(spark, path, APP_LOGS_SCHEMA, cluster=("timestamp",))


def rejections_table(spark: SparkSession, path: str) -> ManifestTable:
    """The quarantine of J2."""
    schema = T.StructType.fromDDL("raw_id BIGINT, api_key STRING, received_at TIMESTAMP_NTZ, reason STRING")
    return ManifestTable(spark, path, schema, ts="received_at", inserted="received_at", cluster=("received_at",))
