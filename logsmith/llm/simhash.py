"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves of 32 bits. Two fingerprints at ``d <= 3`` bits agree in
one half up to one bit, so the Hamming ball of radius one around each half is enumerated (of
two halves that differ in a bit, the one that has it unset probes for the other), the probes
fetch the fingerprints whose half is met, and the complete distance is verified in the join.
Equal fingerprints are one node; links become components without collecting anything.

Defined results: null and empty texts and texts without words have fingerprint zero and are
linked like others; texts are taken whole; repeated rows share a component; a null id never is
the smallest id of a component unless all are null; an empty table gives no rows; other
columns are ignored (``representatives`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsmith.llm.common import staged, utf8
from logsmith.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
HALF = 32
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 17


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the word shingles (repeats included) as a signed integer."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: Column, size: int = SHINGLE_WORDS) -> Column:
    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(x.as_py(), size) for x in batch], pa.int64())

    return hashed(utf8(text))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) for distinct fingerprints (column ``fp``) at 1 to ``max_bits`` differing bits; a
    pair may come once per half."""
    if not 0 <= max_bits <= 3:
        raise ValueError("balls of radius one around two halves find at most 3 differing bits")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", HALF).alias("key")),
    )
    stored = prints.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.key")
    probes = (
        stored.select(F.col("fp").alias("u"), "half", "key", F.explode(F.sequence(F.lit(-1), F.lit(HALF - 1))).alias("at"))
        .where("at < 0 or (shiftrightunsigned(key, at) & 1) = 0")
        .select("u", "half", F.expr("if(at < 0, key, key | shiftleft(1L, at)) AS key"), (F.col("at") < 0).alias("same"))
    )
    # a broadcast would be chosen by the size of the file, which knows nothing of what explode adds
    met = probes.hint("merge").join(stored.withColumnRenamed("fp", "v"), ["half", "key"])
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).where("u <> v and (not same or u < v)").select("u", "v")


def group_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, keeper): for each fingerprint of (doc_id, fp) rows the smallest id
    reachable, and whether this fingerprint is the one that carries it."""
    known = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-prints")
    roots = connected_components(links(known, max_bits))
    placed = known.join(roots, known.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    # the smallest id, and the smallest fingerprint among those that carry it
    first = F.min(F.struct(F.col("least_id").isNull().alias("no_id"), F.col("least_id"), F.col("fp")))
    heads = placed.groupBy("root").agg(first.alias("h")).select(
        "root", F.col("h.least_id").alias("component_id"), F.col("h.fp").alias("head")
    )
    return placed.join(heads, "root").select("fp", "component_id", (F.col("fp") == F.col("head")).alias("keeper"))


def near_duplicates(docs: DataFrame, text_col: str = "text", size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = staged(docs.select("doc_id", simhash(F.col(text_col), size).alias("fp")), "simhash-docs")
    groups = group_fingerprints(prints, max_bits).select("fp", "component_id")
    # both sides grow with the documents, and repeated fingerprints make a file far smaller than its rows
    return prints.hint("merge").join(groups, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, text_col: str = "text", size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest id (of repeated rows with
    this id and fingerprint, the first by a hash of the text)."""
    printed = staged(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), simhash(F.col(text_col), size).alias("fp")), "simhash-rows")
    heads = group_fingerprints(printed.select("doc_id", "fp"), max_bits).where("keeper").select(
        F.col("fp").alias("head_fp"), "component_id"
    )
    same = (F.col("fp") == F.col("head_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    left = printed.join(heads, same, "left_semi")
    own = Window.partitionBy("fp").orderBy(F.xxhash64(f"row.{text_col}"))
    return left.withColumn("_n", F.row_number().over(own)).where("_n = 1").select("row.*")
