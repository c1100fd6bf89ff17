"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items (a shorter item
is one window). Over the words of a text, the shift table of the last two words of the current
window tells how far it can move without missing a pattern; where the shift is zero, the bucket
of those two words (the suffix hash) selects the patterns that end so, and comparing the whole
window confirms an occurrence. Patterns of one length share a table; short items, which would
shorten everybody's shifts, are searched in tables of their own.

The benchmark is the query set: it is taken in blocks of bounded size, each broadcast and
searched in all documents.

Defined results: null texts have no words; an item without words has no window; rows with the
same item id are one item, a null id counts as hits but names no item; repeated documents are
searched again; texts are taken whole, in segments of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logsmith.llm.common import staged, utf8

WINDOW = 10
#: Bytes of benchmark text in a block (the tables in each worker take some tens of that).
BLOCK_BYTES = 8 << 20
#: Bytes of a text that are split into words at a time.
SEGMENT_BYTES = 4 << 20

#: Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; all other
#: bytes part them.
_PARTED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PARTED).split()


class Patterns:
    """Shift tables and suffix buckets of patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.ending: dict[tuple, dict[tuple, set]] = {}

    def add(self, window: tuple, item: str | None) -> None:
        for end in range(self.block, self.length + 1):
            part = window[end - self.block : end]
            self.shift[part] = min(self.shift.get(part, self.furthest), self.length - end)
        self.ending.setdefault(window[-self.block :], {}).setdefault(window, set()).add(item)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of each window that is a pattern."""
        shift, furthest, length, block = self.shift.get, self.furthest, self.length, self.block
        at, n = length, len(words)
        while at <= n:
            part = tuple(words[at - block : at])
            step = shift(part, furthest)
            if step:
                at += step
                continue
            window = tuple(words[at - length : at])
            if (items := self.ending[part].get(window)) is not None:
                yield at - length, items
            at += 1


def compile_patterns(items: Iterable[tuple[str | None, bytes]], window: int = WINDOW) -> list[Patterns]:
    tables: dict[int, Patterns] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        if size:
            table = tables.setdefault(size, Patterns(size))
            for at in range(len(words) - size + 1):
                table.add(tuple(words[at : at + size]), item)
    return [tables[k] for k in sorted(tables)]


def _segments(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    if len(text) <= SEGMENT_BYTES:
        yield words_of(text)
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + SEGMENT_BYTES)
        while end < len(text) and _PARTED[text[end]] != 0x20:  # never inside a word
            end += 1
        yield words_of(text[at:end])
        at = end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def search(text: bytes, tables: list[Patterns]) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, the maximal runs [start, end) of words inside occurrences, the items."""
    longest = max((t.length for t in tables), default=1)
    spans, items, before, carried = [], set(), 0, []
    for new in _segments(text):
        words = carried + new
        for table in tables:
            for start, found in table.occurrences(words):
                spans.append((before + start, before + start + table.length))
                items |= found
        keep = min(len(words), longest - 1)
        before += len(words) - keep
        carried = words[len(words) - keep :]
    return before + len(carried), _merged(spans), items


_FOUND = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The distinct items in blocks of about ``block_bytes`` (one larger item comes alone)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8("text").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], bytes(r["text"])) for r in block.collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside occurrences), ``hit_spans`` (their
    maximal runs, in words) and ``items`` (ids of the items that occur, sorted as strings);
    columns of these names are replaced."""
    spark = docs.sparkSession
    out = docs.withColumn("_found", F.lit(None).cast(_FOUND))
    blocks = _blocks(spark, benchmark, block_bytes)
    for k, block in enumerate(blocks):
        if k:  # one block of tables in memory at a time
            out = staged(out, "decontam")
        tables = spark.sparkContext.broadcast(compile_patterns(block, window))

        @F.arrow_udf(_FOUND)
        def searched(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, earlier in batches:
                rows = []
                for text, known in zip(texts, earlier):
                    n, spans, items = search(text.as_py(), tables.value)
                    if (known := known.as_py()) is not None:
                        spans = spans + [(s["start"], s["end"]) for s in known["spans"]]
                        items = items | set(known["items"])
                    rows.append(
                        {
                            "n_words": n,
                            "spans": [{"start": s, "end": e} for s, e in _merged(spans)],
                            "items": sorted(i for i in items if i is not None),
                        }
                    )
                yield pa.array(rows, _ARROW)

        out = out.withColumn("_found", searched(utf8(text_col), F.col("_found")))
    runs = F.col("_found.spans")
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumns(
        {"n_words": F.col("_found.n_words"), "n_hit": n_hit, "hit_spans": runs, "items": F.col("_found.items")}
    ).drop("_found")
