"""Repeated substrings by sorted suffixes.

Every byte covered by a string of ``depth`` bytes that also starts elsewhere in the corpus is
removed. Strings are judged on the input; matches never cross documents.

The corpus is cut so that equal strings meet. The least hash of the short grams of a string of
``depth`` bytes depends on the string alone, so all its occurrences lie in regions (maximal
runs of starts with one least hash) of the same hash. Regions whose hash occurs once cannot
repeat and go no further; equal regions are counted, and the distinct regions of a hash are
gathered in shards, where external induced sorting (``induced``) puts their suffixes in order
and tells which starts share ``depth`` bytes with a neighbour. A hash with more regions than a
shard holds (text around a very common passage) is not gathered in one task: its regions are cut
again by longer grams, which tell apart what surrounds the passage, and go through the same
steps, round by round until every group fits. The last grams are whole strings of ``depth`` bytes,
where equal regions are all that is left of a group.

Defined results: null and empty texts have nothing to remove; a text shorter than ``depth``
never repeats; rows with equal id and text are different places, so both lose what they share;
null ids are told apart by their texts; a removed run may cut a character, so what is kept is
bytes; extra columns pass through, columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logsmith.llm.common import staged, utf8
from logsmith.llm.induced import Shard

DEPTH = 400
#: Bytes of region text that are sorted together in a task.
SHARD_BYTES = 3 << 20
#: Bytes of a text whose grams are hashed at a time.
CHUNK_BYTES = 1 << 20

_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(CHUNK_BYTES + (1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values: running minima of blocks from both sides."""
    n = len(values) - width + 1
    blocks = np.append(values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _grams(depth: int) -> list[int]:
    """Gram lengths of the rounds."""
    return sorted({max(1, n) for n in (depth // 6, depth // 2, depth * 3 // 4, depth - depth // 16, depth)})


def regions(text: bytes, depth: int, gram: int | None = None) -> Iterator[tuple[int, int, int, bool]]:
    """(least hash, first start, number of starts, whether the hash is met again nearby) of each
    region of a text. Only where it is met again can a region repeat a string in itself. With
    grams of the whole depth every start is a region."""
    gram = gram or _grams(depth)[0]
    for begin in range(0, len(text) - depth + 1, CHUNK_BYTES):
        data = np.frombuffer(text, np.uint8, min(len(text) - begin, CHUNK_BYTES + depth - 1), begin)
        hashes = gram_hashes(data, gram)
        least = sliding_least(hashes, depth - gram + 1)
        first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (gram == depth)))
        count = np.diff(np.append(first, len(least)))
        # grams that are the least of some string: by 16 bits first, then all of them
        maybe = np.zeros(1 << 16, bool)
        maybe[least[first] & np.uint64(0xFFFF)] = True
        found = hashes[maybe[hashes & np.uint64(0xFFFF)]]
        values, times = np.unique(found[np.isin(found, least[first])], return_counts=True)
        again = np.isin(least[first], values[times > 1])
        yield from zip(least[first].view(np.int64).tolist(), (first + begin).tolist(), count.tolist(), again.tolist())


_REGION = pa.struct([("h", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("again", pa.bool_())])


def _regions_of(data: Column, depth: int, gram: int) -> Column:
    """All regions of a text, with a 128-bit hash of their bytes."""

    @F.arrow_udf("array<struct<h: bigint, r1: bigint, r2: bigint, start: bigint, n: bigint, again: boolean>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, columns = [0], [[], [], [], []]
            digests = bytearray()
            for x in batch:
                text = x.as_py()
                for h, start, n, again in regions(text, depth, gram):
                    for column, value in zip(columns, (h, start, n, again)):
                        column.append(value)
                    digests += xxhash.xxh3_128_digest(text[start : start + n + depth - 1])
                offsets.append(len(columns[0]))
            r = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            arrays = [columns[0], r[:, 0], r[:, 1], *columns[1:]]
            rows = pa.StructArray.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, _REGION)], fields=list(_REGION))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return cut(data)


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SORTED = "h long, r1 long, r2 long, runs array<struct<a: long, b: long>>"


def _runs(starts: np.ndarray) -> list[dict]:
    """Maximal runs [a, b) of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1])
    return [{"a": a, "b": b + 1} for a, b in zip(first.tolist(), last.tolist())]


def _sort_shards(depth: int, shard_bytes: int):
    """Whole groups of one hash (rows sorted by it) fill a shard; a full one is sorted."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, last = Shard(depth), [], None

        def finished() -> pa.RecordBatch:
            runs = [_runs(s) for s in shard.repeated_starts()]
            columns = list(zip(*keys)) or [[], [], []]
            arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array(runs, _RUNS)]
            return pa.RecordBatch.from_arrays(arrays, names=["h", "r1", "r2", "runs"])

        for batch in batches:
            for h, r1, r2, size, data in zip(*batch.columns):
                h = h.as_py()
                if h != last and shard.size and shard.size + size.as_py() > shard_bytes:
                    yield finished()
                    shard, keys = Shard(depth), []
                last = h
                shard.add(data.as_py())
                keys.append((h, r1.as_py(), r2.as_py()))
        yield finished()

    return sort


def _cut(data: Column, spans: Column) -> Column:
    """``struct<kept: binary, n_removed, n_spans>``: the text without the spans, which may
    overlap."""

    @F.arrow_udf("struct<kept: binary, n_removed: bigint, n_spans: bigint>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            kept, removed, counts = [], [], []
            for x, s in zip(texts, found):
                text, parts, end, n, gone = x.as_py(), [], 0, 0, 0
                for a, b in sorted((r["a"], r["b"]) for r in s.as_py() or []):
                    if a > end or not n:
                        parts.append(text[end:a])
                        n += 1
                        gone += b - a
                    else:
                        gone += max(0, b - end)
                    end = max(end, b)
                parts.append(text[end:])
                kept.append(b"".join(parts))
                removed.append(gone)
                counts.append(n)
            arrays = [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.StructArray.from_arrays(arrays, ["kept", "n_removed", "n_spans"])

    return cut(data, spans)


def _spans(rows: DataFrame, depth: int, grams: list[int], shard_bytes: int) -> DataFrame:
    """(id, text_hash, spans) of ``rows`` (id, text_hash, data), cut by the first of ``grams``."""
    cut = rows.select("id", "text_hash", F.explode(_regions_of(F.col("data"), depth, grams[0])).alias("g")).select("id", "text_hash", "g.*")
    cut = staged(cut, "suffix-cut")  # read twice
    # the sides by hash are staged, too: a join of two plain shuffles can split a hot hash
    met = cut.groupBy("h").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("h")
    likely = staged(cut.join(staged(met, "suffix-met"), "h", "left_semi"), "suffix-regions")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "start")
    distinct = staged(
        likely.groupBy("h", "r1", "r2", "n").agg(F.count("*").alias("times"), F.max("again").alias("again"), F.min(place).alias("at")), "suffix-distinct"
    )
    # groups in which some region occurs once but is not alone, or meets its gram again
    size = F.sum(F.col("n") + depth)
    counts = [F.count("*").alias("k"), F.min("times").alias("least"), F.max("again").alias("again"), size.alias("size")]
    groups = staged(distinct.groupBy("h").agg(*counts).where("(k > 1 or again) and least = 1").select("h", "size"), "suffix-groups")
    wanted = staged(
        distinct.join(groups, "h").select("h", "r1", "r2", "n", "size", "at.id", "at.text_hash", "at.start"),
        "suffix-wanted",
    )
    held, largest = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    asked = wanted.withColumnsRenamed({"id": "id_", "text_hash": "hash_"})
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    region = F.expr(f"substring(data, int(start) + 1, int(n) + {depth - 1})")
    fetched = rows.join(asked, same).select("h", "r1", "r2", "size", region.alias("data"))
    again = largest > shard_bytes and len(grams) > 1
    if again:
        fetched = staged(fetched, "suffix-fetched")
    cold = fetched.where(F.col("size") <= shard_bytes) if again else fetched
    shards = max(1, -(-int(held) // shard_bytes))
    runs = cold.repartition(shards, "h").sortWithinPartitions("h").mapInArrow(_sort_shards(depth, shard_bytes), _SORTED)
    if again:
        hot = fetched.where(F.col("size") > shard_bytes).select(F.struct("h", "r1", "r2").alias("id"), F.col("r1").alias("text_hash"), "data")
        found = F.transform("spans", lambda s: F.struct(s["a"].alias("a"), (s["b"] - (depth - 1)).alias("b")))
        runs = runs.unionByName(_spans(hot, depth, grams[1:], shard_bytes).select("id.*", found.alias("runs")))
    all_starts = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    whole = distinct.where("times > 1").select("h", "r1", "r2", all_starts.alias("runs"))
    marked = runs.where(F.size("runs") > 0).unionByName(whole)
    spans = likely.join(marked, ["h", "r1", "r2"]).select("id", "text_hash", "start", F.explode("runs").alias("r"))
    span = F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (depth - 1)).alias("b"))
    return spans.select("id", "text_hash", span.alias("span")).groupBy("id", "text_hash").agg(F.collect_list("span").alias("spans"))


def find_repeats(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, text_hash, spans): the spans [a, b) of bytes to remove, which may overlap, of each
    document that has any."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_col).alias("text_hash"), utf8(text_col).alias("data"))
    return _spans(rows, depth, _grams(depth), shard_bytes)


def remove_repeats(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``kept`` (bytes), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal
    removed runs)."""
    spans = find_repeats(docs, text_col, depth, shard_bytes).withColumnsRenamed({"id": "_id", "text_hash": "_hash", "spans": "_spans"})
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64(text_col).alias("_own_hash"), utf8(text_col).alias("_data"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    done = keyed.join(spans, same, "left").select("_row", "_data", _cut(F.col("_data"), F.col("_spans")).alias("_c"))
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    return done.select(
        *(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in new),
        "_c.kept",
        F.octet_length("_data").cast("long").alias("n_bytes"),
        "_c.n_removed",
        "_c.n_spans",
    )
