"""WARC archives: a deterministic sharded writer and its reader.

Writing. The ranges of the shards follow from exact byte counts per slice of the id range (and,
inside a slice that is too heavy, of the payload digest), so they depend on the rows alone.
Rows go to their shard, are sorted there by id and digest and streamed into gzip members, one
per record; a file is closed when its compressed size passes the limit. Headers, record ids
and digests are made anew from the payloads. Files appear under temporary names of the task
attempt and are renamed when complete; a shard's manifest is renamed into place after its
files, and the archive's manifest is written last, so a reader sees complete shards only and a
retried or speculative task ends in the same names and bytes.

Of records with equal payloads the one with the smallest id is a response, the others are
revisits that refer to it. The decision needs digests only; it travels to the shard as a small
row sorted before the page's own, so payloads are shuffled once.

Reading. The files named by the manifest are read in parallel, a member at a time; digests and
lengths are verified.

Defined results: a null payload is empty; null ids are one id, sorted last; of rows with equal
id and payload the first one written is the response; line breaks in a url are percent-encoded;
an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from logsmith.llm.common import utf8
from logsmith.session import scratch_path

#: Payload bytes of a shard, about; compressed bytes at which a file is closed.
SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
#: Payloads of at least this many bytes are written once.
MIN_REVISIT_BYTES = 0
#: Slices of the id range, and of a heavy slice's digests, whose bytes are counted.
SLICES = 4096
WARC_DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest"
_LINE_BREAK = re.compile("[\\r\\n]")

_FILES = "shard int, file string, bytes long, records long, sha256 string"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a shared folder, as tasks open it (file:, hdfs:, s3: ...)."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def _commit(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename into place; what an earlier attempt left there has the same bytes and gives way
    (stores differ in whether a rename replaces)."""
    if fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(temporary, final)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}/{copy}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without time or name
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, first: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps the HTTP head of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", _LINE_BREAK.sub(lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", record_id(first, digest, 0)),
            ("X-Refers-To-Page-ID", "" if first is None else str(first)),
        ]
    return _record(headers, block)


class ShardWriter:
    """The files of one shard: rolled by compressed size, committed by renaming."""

    def __init__(self, root: str, shard: int, attempt: str, file_bytes: int):
        self.fs, self.dir = _filesystem(root)
        self.shard, self.attempt, self.file_bytes = shard, attempt, file_bytes
        self.files: list[dict] = []
        self.stream = None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{len(self.files):05d}.warc.gz"
        self.temporary = f"{self.dir}/_temporary/{self.attempt}/{self.name}"
        self.fs.create_dir(f"{self.dir}/_temporary/{self.attempt}", recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.digest, self.size, self.records = hashlib.sha256(), 0, 0
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, 0)), ("WARC-Date", WARC_DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._put(_record(info, b"format: WARC File Format 1.1\r\n"))

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.digest.update(member)
        self.size += len(member)

    def add(self, member: bytes) -> None:
        if self.stream is None:
            self._open()
        self._put(member)
        self.records += 1
        if self.size >= self.file_bytes:
            self._finish()

    def _finish(self) -> None:
        self.stream.close()
        self.stream = None
        _commit(self.fs, self.temporary, f"{self.dir}/{self.name}")
        self.files.append({"file": self.name, "bytes": self.size, "records": self.records, "sha256": self.digest.hexdigest()})

    def close(self) -> list[dict]:
        if self.stream is not None:
            self._finish()
        name = f"shard-{self.shard:06d}.json"
        temporary = f"{self.dir}/_temporary/{self.attempt}/{name}"
        with self.fs.open_output_stream(temporary, compression=None) as out:
            out.write(json.dumps(self.files).encode())
        _commit(self.fs, temporary, f"{self.dir}/{name}")
        return self.files


def _write_shards(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        writer: ShardWriter | None = None
        key, copy, decided = None, 0, None
        rows: list[tuple] = []

        def closed() -> None:
            rows.extend((writer.shard, f["file"], f["bytes"], f["records"], f["sha256"]) for f in writer.close())

        for batch in batches:
            for shard, page_id, digest, kind, first, url, html in zip(*batch.columns):
                shard, page_id, digest = shard.as_py(), page_id.as_py(), digest.as_py()
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        closed()
                    writer, key = ShardWriter(root, shard, attempt, file_bytes), None
                if (page_id, digest) != key:
                    key, copy, decided = (page_id, digest), 0, None
                if kind.as_py() == 0:
                    decided = (first.as_py(),)  # this payload's response
                    continue
                payload = html.as_py()
                revisit = decided is not None and (copy > 0 or decided[0] != page_id)
                name = base32_sha1(payload)
                writer.add(page_record(page_id, url.as_py(), payload, name, copy, decided[0] if revisit else None, revisit))
                copy += 1
        if writer is not None:
            closed()
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "file", "bytes", "records", "sha256"])

    return write


def _shard_of(rows: DataFrame, shard_bytes: int):
    """A column that numbers the shards in order, from exact counts of bytes: at most ``SLICES``
    slices of the id range, of which heavy ones are cut by the digest."""
    ends = rows.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0, 0) if ends[0] is None else (int(ends[0]), int(ends[1]))
    width = max(1, -(-(high - low + 1) // SLICES))
    position = F.when(F.col("page_id").isNull(), SLICES).otherwise(
        F.floor((F.col("page_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
    ).cast("int")
    sizes = {r["at"]: r["size"] for r in rows.groupBy(position.alias("at")).agg(F.sum(F.col("n_bytes") + 512).alias("size")).collect()}
    base, parts, shard, held = [0] * (SLICES + 1), [1] * (SLICES + 1), 0, 0
    for at in range(SLICES + 1):
        size = sizes.get(at, 0)
        if held and held + size > shard_bytes:
            shard, held = shard + 1, 0
        base[at] = shard
        if size > shard_bytes:  # a heavy slice (or one hot id) fills shards of its own
            parts[at] = -(-size // shard_bytes)
            shard, held = shard + parts[at], 0
        else:
            held += size
    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    at = position + 1
    cut = F.floor(prefix * F.element_at(F.lit(parts), at) / F.lit(float(1 << 32))).cast("int")
    return (F.element_at(F.lit(base), at) + cut).alias("shard"), shard + 1


def write_warc(
    pages: DataFrame,
    path: str,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write a record per row of (page_id, url, html) into the new folder ``path`` of a shared
    store; its manifest has a row per file: shard, file, bytes, records, sha256."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("html")
    ).withColumn("digest", F.sha1("html"))
    narrow = rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("n_bytes"))
    shard, n_shards = _shard_of(narrow, shard_bytes)
    # of payloads met more than once: their smallest id
    alike = narrow.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    told = narrow.join(alike.select("digest", "first"), "digest").select("page_id", "digest", "first").distinct()
    empty = F.lit(None)
    decisions = told.select(
        shard, "page_id", "digest", F.lit(0).alias("kind"), "first", empty.cast("string").alias("url"), empty.cast("binary").alias("html")
    )
    records = rows.select(shard, "page_id", "digest", F.lit(1).alias("kind"), empty.cast("long").alias("first"), "url", "html")
    placed = records.unionByName(decisions).repartitionById(n_shards, "shard")
    ordered = placed.sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "digest", "kind", "url")
    written = ordered.mapInArrow(_write_shards(path, file_bytes), _FILES)
    written.write.parquet(f"{path}/_{MANIFEST}")  # runs the job; rows per file, never collected
    fs, root = _filesystem(path)
    fs.move(f"{root}/_{MANIFEST}", f"{root}/{MANIFEST}")


def parse_records(stream, file: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member."""
    rest = b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        unpack, parts = zlib.decompressobj(31), []
        while data:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                break
            data = stream.read(1 << 20)
        if not unpack.eof:
            raise ValueError(f"{file}: truncated member")
        rest = unpack.unused_data
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        if lines[0] != "WARC/1.1" or block[-4:] != b"\r\n\r\n" or len(block) - 4 != int(headers["Content-Length"]):
            raise ValueError(f"{file}: malformed record")
        yield headers, block[:-4]


def _read_files(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(root)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    for headers, block in parse_records(stream, file):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{file}: block digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{file}: payload digest")
                        page, first = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID", "")
                        rows.append((int(page) if page else None, size, digest, kind, int(first) if first else None, headers["WARC-Target-URI"]))
                columns = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return read


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the committed files: page_id, payload_bytes, payload_digest,
    record_type, refers_to, target_uri."""
    files = spark.read.schema(_FILES).parquet(f"{path}/{MANIFEST}").select("file")
    return files.repartition(max(1, files.count())).mapInArrow(_read_files(path), _RECORD)


def archive_pages(pages: DataFrame, **limits) -> DataFrame:
    """Write ``pages`` into a new folder of the shared checkpoint directory and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, **limits)
    return read_warc(spark, path)
