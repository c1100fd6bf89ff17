"""Which files of a table under a manifest can hold a value (F17, F4): an inverted index beside
the data files.

Every commit that adds data files also writes, for each index of the table, a row per (hashed
term, file), sorted by the hash, so that a lookup by a few hashes reads a few row groups. A
lookup joins these rows with the live files: it returns the files that hold all terms. Files of
commits without an index (written before it existed) always count as candidates, so no file that
holds the value is ever left out; hashes that collide only add files. The rows themselves are
filtered as usual afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: length of the parts that a text is indexed by.
GRAM = 3


@dataclass(frozen=True)
class FileIndex:
    """``terms``: array of the texts by which a row is found (empty ones and nulls are not)."""

    name: str
    terms: Callable[[], Column]


def grams(text: str) -> list[str]:
    """Parts of a search text as the index has them; none if it is too short to be looked up."""
    text = text.lower()
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def _grams_of(column: str) -> Column:
    low = f"lower({column})"
    every = f"transform(sequence(1, length({low}) - {GRAM - 1}), i -> substr({low}, i, {GRAM}))"
    return F.expr(f"if(length({column}) >= {GRAM}, array_distinct({every}), array())")


TRACE_INDEX = FileIndex("trace", lambda: F.array("trace_id"))
MESSAGE_INDEX = FileIndex("message", lambda: _grams_of("message"))


def write_index(rows, index: FileIndex, root: str, commit: str) -> None:
    """Index the rows of the files of one commit (read with ``_metadata``)."""
    below = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
    terms = rows.select(F.explode(index.terms()).alias("text"), below.alias("path")).where("text <> ''")
    pairs = terms.select(F.xxhash64("text").alias("term"), "path").distinct()
    pairs.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/index/{index.name}/commit={commit}")


def files_holding(table, snapshot, index: FileIndex, texts: Sequence[str]) -> list:
    """The live files that can hold all of ``texts``: a row per candidate file comes to the driver."""
    wanted = sorted(set(texts))
    if not wanted:
        return list(snapshot.files)
    root = f"{table.path}/index/{index.name}"
    indexed = {s.getPath().getName().split("=", 1)[1] for s in table._list(root)}
    commit = lambda f: f.path.split("/", 1)[0].split("=", 1)[1]
    commits = sorted({commit(f) for f in snapshot.files} & indexed)
    if not commits:
        return list(snapshot.files)
    found = table.spark.read.schema("term BIGINT, path STRING").parquet(*(f"{root}/commit={c}" for c in commits))
    hashes = [F.xxhash64(F.lit(t)) for t in wanted]
    holding = found.where(F.col("term").isin(hashes)).groupBy("path").agg(F.count_distinct("term").alias("n"))
    enough = {r["path"] for r in holding.where(F.col("n") >= _distinct(table.spark, wanted)).select("path").collect()}
    return [f for f in snapshot.files if f.path in enough or commit(f) not in indexed]


def _distinct(spark, texts: list[str]) -> int:
    """Number of different hashes of the texts."""
    return len({r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()})
