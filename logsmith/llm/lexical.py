"""Ranked lexical search: every query item against all documents, over an FP-tree of documents.

The items are the query set: they are taken in blocks of bounded size, and a document is reduced
to its vector of the block's terms. The terms of a vector stand in descending order of document
frequency, so vectors with the same frequent terms share a path of the trie. A node holds the
largest tf of each term and the smallest m among the documents below it; the score of an item
with these is never below that of any of them. The trie is searched depth first, best bound
first, with a threshold per item: its k-th best score so far. A branch is left out for the items
whose bound it cannot pass, and a bucket of documents at its end is scored exactly for the
others. Each task builds the tries of its own documents in chunks of bounded memory; the best
of the tasks meet in a top-k by item, dealt over salts first.

Statistics (documents, terms, document frequencies) are counted over all documents.

Defined results: null and empty texts and texts without terms are no documents of the
statistics; distinct texts with one item id (null included) are one item with the terms of all
of them, repeated rows of an item count once; items without terms have no rows; repeated
documents are ranked one by one; equal scores go by ascending document id, null last; texts are
taken whole, in segments of bounded memory; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsmith.llm.common import staged, utf8
from logsmith.llm.decontam import _segments

#: Results of an item, and bytes of item text in a block.
K = 10
BLOCK_BYTES = 1 << 20
#: Documents of a bucket at the end of a path; a child that holds more than this share of its
#: parent's documents is taken into the parent, which bounds depth and number of nodes.
BUCKET = 32
SPLICE = 0.75
#: A chunk's trie: entries of its vectors, and cells of the maxima of its nodes.
CHUNK_ENTRIES = 2_000_000
CHUNK_CELLS = 8_000_000
#: Cells of a bucket's score matrix at a time.
SCORE_CELLS = 2_000_000
#: Salts of the first step of the final top-k.
SALTS = 64


def part(tf, m):
    """What one occurrence list adds for a weight of one (integers, rounded down)."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def term_counts(text: bytes) -> tuple[int, Counter]:
    counts: Counter = Counter()
    for words in _segments(text):
        counts.update(words)
    return sum(counts.values()), counts


def _vectors(text: Column, vocabulary) -> Column:
    """``struct<n, terms, tfs>``: the number of terms of a text, and those of the vocabulary."""
    kind = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n: bigint, terms: array<int>, tfs: array<bigint>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary.value
        for batch in batches:
            ns, terms, tfs, ends = [], [], [], [0]
            for x in batch:
                n, counts = term_counts(x.as_py())
                ns.append(n)
                for word, tf in counts.items():
                    if (term := known.get(word)) is not None:
                        terms.append(term)
                        tfs.append(tf)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.StructArray.from_arrays([pa.array(ns, pa.int64()), *lists], fields=list(kind))

    return made(text)


@dataclass
class Items:
    """The items of a block: for each, ranks of its terms and what an occurrence list is worth
    (weight times repeats), one after the other."""

    ends: np.ndarray
    ranks: np.ndarray
    worth: np.ndarray
    numbers: np.ndarray  # of the items in the block

    @staticmethod
    def of(counted: list[Counter], rank: list[int], weights: list[int]) -> "Items":
        ends, ranks, worth, numbers = [0], [], [], []
        for number, terms in enumerate(counted):
            of_item = sorted((rank[t], weights[t] * r) for t, r in terms.items() if weights[t] > 0)
            if of_item:
                ranks += [r for r, _ in of_item]
                worth += [w for _, w in of_item]
                numbers.append(number)
                ends.append(len(ranks))
        return Items(*(np.array(x, np.int64) for x in (ends, ranks, worth, numbers)))

    def only(self, places: np.ndarray) -> "Items":
        """The items at ``places`` (ascending)."""
        sizes = np.diff(self.ends)[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ends[places] - ends[:-1], sizes) + np.arange(ends[-1])
        return Items(ends, self.ranks[at], self.worth[at], self.numbers[places])

    def within(self, ranks: np.ndarray) -> "Items":
        """Terms as columns of the ascending ``ranks``; other terms, and items without any of
        them, go."""
        at = np.searchsorted(ranks, self.ranks)
        here = (at < len(ranks)) & (ranks[np.minimum(at, len(ranks) - 1)] == self.ranks)
        of = np.repeat(np.arange(len(self.numbers)), np.diff(self.ends))[here]
        sizes = np.bincount(of, minlength=len(self.numbers))
        some = sizes > 0
        return Items(np.concatenate([[0], np.cumsum(sizes[some])]), at[here], self.worth[here], self.numbers[some])

    def totals(self, parts: np.ndarray) -> np.ndarray:
        """Scores of all items from the parts by column (last axis)."""
        return np.add.reduceat(parts[..., self.ranks] * self.worth, self.ends[:-1], axis=-1)


@dataclass
class Node:
    """Documents [start, end) in path order, what bounds their scores, and the branches; a node
    without branches is a bucket."""

    start: int
    end: int
    tf: np.ndarray
    m: int
    first_id: float
    kids: list["Node"] = field(default_factory=list)


class Trie:
    """FP-tree of a chunk of documents, compressed to its branching nodes."""

    def __init__(self, ids: list, ms: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], bucket: int = BUCKET):
        self.ranks = np.unique(np.concatenate([r for r, _ in vectors]))  # columns of the maxima
        paths = []
        for ranks, tfs in vectors:
            order = np.argsort(ranks)  # the most frequent term first
            paths.append((np.searchsorted(self.ranks, ranks[order]), tfs[order]))
        keys = [p.astype(">u4").tobytes() for p, _ in paths]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.ids = [ids[i] for i in order]
        self.ms = ms[order]
        self.paths = [paths[i] for i in order]
        self.bucket = bucket
        # shared[i]: terms of the path that the documents i - 1 and i have in common
        self.shared = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            a, b = self.paths[i - 1][0], self.paths[i][0]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.shared[i] = differ[0] if len(differ) else k
        self.root = self._node(0, len(order))

    def _split(self, start: int, end: int) -> list[tuple[int, int]]:
        """The branches where the paths of [start, end) part first."""
        inner = self.shared[start + 1 : end]
        cuts = [start, *(np.flatnonzero(inner == inner.min()) + start + 1).tolist(), end]
        return list(zip(cuts, cuts[1:]))

    def _branches(self, start: int, end: int) -> list[tuple[int, int]]:
        most, out, todo = SPLICE * (end - start), [], [(start, end)]
        while todo:
            a, b = todo.pop()
            if b - a > self.bucket and b - a > most:
                todo += reversed(self._split(a, b))
            elif out and out[-1][1] == a and b - out[-1][0] <= self.bucket:
                out[-1] = out[-1][0], b  # neighbours share a bucket
            else:
                out.append((a, b))
        return out

    def _node(self, start: int, end: int) -> Node:
        if end - start <= self.bucket:
            tf = np.zeros(len(self.ranks), np.int64)
            for ranks, tfs in self.paths[start:end]:
                tf[ranks] = np.maximum(tf[ranks], tfs)
            first = min(math.inf if i is None else i for i in self.ids[start:end])
            return Node(start, end, tf, int(self.ms[start:end].min()), first)
        kids = [self._node(a, b) for a, b in self._branches(start, end)]
        tf = kids[0].tf.copy()
        for kid in kids[1:]:
            np.maximum(tf, kid.tf, out=tf)
        return Node(start, end, tf, min(k.m for k in kids), min(k.first_id for k in kids), kids)

    def scores(self, node: Node, items: Items) -> Iterator[tuple[int, np.ndarray]]:
        """Exact scores of the documents of a bucket, document by document."""
        step = max(1, SCORE_CELLS // max(1, len(items.ranks)))
        for a in range(node.start, node.end, step):
            b = min(a + step, node.end)
            parts = np.zeros((b - a, len(self.ranks)), np.int64)
            for i in range(a, b):
                ranks, tfs = self.paths[i]
                parts[i - a, ranks] = part(tfs, int(self.ms[i]))
            yield from zip(range(a, b), items.totals(parts))


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.kept: list[list[tuple[int, float]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # the k-th best score, zero while there are fewer
        self.last = np.full(items, -math.inf)  # the id of the k-th best

    def offer(self, item: int, score: int, doc_id) -> None:
        kept = self.kept[item]
        bisect.insort(kept, (-score, math.inf if doc_id is None else doc_id))
        if len(kept) >= self.k:
            del kept[self.k :]
            self.least[item], self.last[item] = -kept[-1][0], kept[-1][1]

    def may_enter(self, numbers: np.ndarray, bounds: np.ndarray, first_id: float) -> np.ndarray:
        """Which items can still gain from scores up to ``bounds`` and ids from ``first_id`` on."""
        least = self.least[numbers]
        return (bounds > least) | ((bounds == least) & (bounds > 0) & (first_id <= self.last[numbers]))


def search(trie: Trie, items: Items, best: Best) -> int:
    """Branch and bound over a trie, depth first, for all items at once; returns the number of
    documents that were scored."""
    scored = 0

    def descend(node: Node, active: Items, bounds: np.ndarray) -> None:
        nonlocal scored
        able = best.may_enter(active.numbers, bounds, node.first_id)  # thresholds have risen since
        if not able.any():
            return
        if not able.all():
            active = active.only(np.flatnonzero(able))
        if not node.kids:
            scored += node.end - node.start
            for i, scores in trie.scores(node, active):
                for place in np.flatnonzero(best.may_enter(active.numbers, scores, math.inf if trie.ids[i] is None else trie.ids[i])):
                    best.offer(int(active.numbers[place]), int(scores[place]), trie.ids[i])
            return
        below = [(active.totals(part(kid.tf, kid.m)), kid) for kid in node.kids]
        for bound, kid in sorted(below, key=lambda x: -int(x[0].sum())):
            descend(kid, active, bound)

    here = items.within(trie.ranks)
    if len(here.numbers):
        descend(trie.root, here, here.totals(part(trie.root.tf, trie.root.m)))
    return scored


_FOUND = "item int, doc_id bigint, score bigint"


def _searcher(shared, k: int):
    """The search of a task: a trie per chunk, thresholds that last, the best at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rank = shared.value
        best = Best(int(items.numbers.max()) + 1 if len(items.numbers) else 0, k)
        chunk: list[tuple] = []
        entries = 0
        most = max(BUCKET, CHUNK_CELLS * BUCKET // (8 * max(1, len(rank))))  # some nodes per bucket

        def close() -> None:
            if chunk and len(items.numbers):
                ids, ms, *vectors = zip(*chunk)
                search(Trie(list(ids), np.array(ms, np.int64), list(zip(*vectors))), items, best)
            chunk.clear()

        for batch in batches:
            ids, ms = batch.column("doc_id").to_pylist(), batch.column("m").to_pylist()
            terms, tfs = batch.column("terms"), batch.column("tfs")
            ends = terms.offsets.to_numpy()
            ranks, counts = rank[terms.values.to_numpy()], tfs.values.to_numpy()
            other = tfs.offsets.to_numpy()
            for i, (doc_id, m) in enumerate(zip(ids, ms)):
                chunk.append((doc_id, m, ranks[ends[i] : ends[i + 1]], counts[other[i] : other[i + 1]]))
                entries += int(ends[i + 1] - ends[i])
                if entries >= CHUNK_ENTRIES or len(chunk) >= most:
                    close()
                    entries = 0
        close()
        rows = [(item, None if i == math.inf else int(i), -s) for item, kept in enumerate(best.kept) for s, i in kept]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items with their term counts, in blocks of about ``block_bytes`` of text."""
    texts = items.select("item_id", utf8("text").alias("text")).distinct()
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        block = texts if n == 1 else texts.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        counted: dict = {}
        for r in block.collect():
            counted.setdefault(r["item_id"], Counter()).update(term_counts(bytes(r["text"]))[1])
        if counted:
            yield sorted(counted.items(), key=lambda x: (x[0] is None, x[0]))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their ``rank``: first by salted parts, then by item."""
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("item", "_salt").orderBy(*best_first)
    part_best = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    part_best = part_best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k).drop("rank", "_salt")
    return part_best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best_first))).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents (``doc_id, text``) of the highest
    score above 0 for each of ``items`` (``item_id, text``)."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id bigint, score bigint")
    for block in _blocks(items, block_bytes):
        words = sorted(set().union(*(terms for _, terms in block)))
        if not words:
            continue
        number = {w: i for i, w in enumerate(words)}
        vocabulary = spark.sparkContext.broadcast(number)  # at most a block's bytes of words
        made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _vectors(utf8("text"), vocabulary).alias("v"))
        made = staged(made.select("doc_id", "v.n", "v.terms", "v.tfs").where("n > 0"), "lexical-vectors")
        n_docs, length = made.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = [0] * len(words)  # a count per word of the block
        for r in made.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda t: (-df[t], t))] = np.arange(len(words))
        counted = [Counter({number[w]: c for w, c in terms.items()}) for _, terms in block]
        shared = spark.sparkContext.broadcast((Items.of(counted, rank.tolist(), [weight(n_docs, x) for x in df]), rank))
        m = F.expr(f"25 + (75 * n * {n_docs}L) div {length}L").alias("m")
        found = made.where(F.size("terms") > 0).select("doc_id", m, "terms", "tfs").mapInArrow(_searcher(shared, k), _FOUND)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {id_type.simpleString()}")
        ranked = _top(found, k).join(F.broadcast(names), "item")  # as many rows as the block has items
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
