"""Quality rules: an isolation forest on rule statistics.

Two base rules reject a document outright (too few words, too much of it repeated). What they
pass is judged by an isolation forest over the documents' rule statistics: trees of random
splits over all of these statistics inside the box that all labelled rows span. Every labelled
good row of one half is counted in the cells of every tree, so that a document unlike the good
ones in any of them falls into an empty cell after few splits, however rare its kind is among the
bad rows. The anomaly score is ``2 ** (-mean path length / expected path length)``; its threshold
is calibrated on all labelled rows that the trees were not grown on. No labelled row is left out;
counts and running sums are Spark aggregates, and the model has a fixed size.

Defined results: null and empty texts have no words and fail the base rules; texts of any
length are taken whole; repeated rows get the same verdict; without usable labels (empty, all
null, no good rows) there is no forest and the base rules decide alone; extra columns pass
through, columns named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsmith.llm.common import fresh, staged, utf8

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
TREES, DEPTH, SEED = 200, 12, 7
#: Bins of the scores, whose sums are put in order at one place.
SCORE_BINS = 4096
#: Share of the labelled good rows that the threshold has to keep.
KEEP_GOOD = 0.995

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_STATS = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", n_lines: bigint, n_stutter: bigint, n_distinct: bigint>"
_NAMES = [*COUNTS, "n_lines", "n_stutter", "n_distinct"]


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.zeros(n, np.uint64)
        for k in range(size):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0  # equal windows have equal keys
    # the windows that share a key, compared as words
    at = np.flatnonzero(np.isin(keys, twice))
    windows = [tuple(words[i : i + size]) for i in at.tolist()]
    found = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at.tolist(), windows):
        if found[w] > 1:
            covered[i] += 1
            covered[i + size] -= 1
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The rule statistics of one text, in the order of ``_NAMES``."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(bytes.__eq__, words, words[1:])),
        len(set(words)),
    )


def rule_statistics(text: Column) -> Column:
    """``struct`` of the rule statistics of each whole text."""

    @F.arrow_udf(_STATS)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([statistics(x.as_py()) for x in batch], np.int64).reshape(-1, len(_NAMES))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i], pa.int64()) for i in range(len(_NAMES))], _NAMES)

    return stats(utf8(text))


def features(rows: np.ndarray) -> np.ndarray:
    """Shares that do not depend on the length of a text, on scales that spread small values."""
    words, chars, symbols, dup_lines, repeated, lines, stutter, distinct = np.maximum(rows, 0).astype(np.float64).T
    words, chars, lines = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.column_stack(
        [
            np.log(chars / words),
            np.sqrt(symbols / chars),
            dup_lines / lines,
            repeated / words,
            np.sqrt(stutter / words),
            np.log(words / np.maximum(distinct, 1)) / np.log1p(words),
        ]
    )


def _expected(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Full trees in heap order: feature and threshold of the inner nodes, path length at each
    cell (leaf). A node with at most one row ends its path: the cells below it share its length."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    path: np.ndarray | None = None  # trees x cells
    norm: float = 1.0
    limit: float = np.inf

    def cells(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The cell of every row, tree by tree."""
        rows = np.arange(len(x))
        for f, t in zip(self.feature, self.threshold):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] >= t[node])
            yield node - len(f)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for path, at in zip(self.path, self.cells(x)):
            total += path[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def random_trees(low: np.ndarray, high: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """Trees of random splits of the box from ``low`` to ``high``."""
    rng = np.random.default_rng(seed)
    wide = np.flatnonzero(high > low)
    feature = np.zeros((trees, (1 << DEPTH) - 1), np.int8)
    threshold = np.full(feature.shape, -np.inf)  # nothing to split: one way for all rows
    for k in range(trees if len(wide) else 0):
        lo, hi = low[None, :].astype(np.float64), high[None, :].astype(np.float64)
        for depth in range(DEPTH):
            at, nodes = slice((1 << depth) - 1, (2 << depth) - 1), np.arange(1 << depth)
            f = rng.choice(wide, len(nodes))
            t = lo[nodes, f] + (hi[nodes, f] - lo[nodes, f]) * rng.random(len(nodes))
            feature[k, at], threshold[k, at] = f, t
            lo, hi = np.repeat(lo, 2, 0), np.repeat(hi, 2, 0)
            hi[2 * nodes, f] = lo[2 * nodes + 1, f] = t
    return Forest(feature, threshold)


def path_lengths(counts: np.ndarray) -> np.ndarray:
    """Path lengths at the cells, from the rows in each (trees x cells)."""
    levels = [counts]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(counts), -1, 2).sum(2))
    path = np.full((len(counts), 1), -1.0)  # not ended yet
    for depth, here in enumerate(reversed(levels)):
        ends = (path < 0) & ((here <= 1) | (depth == DEPTH))
        path = np.where(ends, depth + _expected(here), path)
        path = np.repeat(path, 2, 1) if depth < DEPTH else path
    return path


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            yield features(np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in _NAMES])), batch


def _box(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Span of the features of all rows."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _batches(batches):
            for f, (low, high) in enumerate(zip(x.min(0).tolist(), x.max(0).tolist())):
                yield pa.RecordBatch.from_pylist([{"f": f, "low": low, "high": high}])

    found = rows.mapInArrow(spans, "f bigint, low double, high double").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    box = sorted(found.collect())  # a row per feature
    return np.array([r["low"] for r in box]), np.array([r["high"] for r in box])


def _counted(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Rows in each cell (trees x cells), counted by the tasks and summed by Spark: what comes to
    the driver is the model, whatever the number of rows."""
    trees, size = len(forest.feature), 1 << DEPTH

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((trees, size), np.int64)
        for x, _ in _batches(batches):
            for k, at in enumerate(forest.cells(x)):
                counts[k] += np.bincount(at, minlength=size)
        cell = np.flatnonzero(counts)
        for i in range(0, len(cell), 1 << 16):
            part = cell[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts.ravel()[part])], ["cell", "n"])

    found = rows.mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(trees * size, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts.reshape(trees, size)


def calibrate(scores: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The threshold that rejects most bad rows among those that keep ``keep_good`` of the good
    ones; halfway to the next score, so that ties fall on one side. ``scores``: ``score`` (0 to
    1) and ``good`` of every row. Equal scores are counted first; running sums are over the scores
    of a bin, and over the sums of the bins."""
    per = scores.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    per = staged(per.withColumn("bin", F.floor(F.col("score") * SCORE_BINS)), "quality-scores")
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # of at most SCORE_BINS + 1 rows
    sums = per.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    bins = sums.select(
        F.col("bin").alias("_bin"), *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "gb"))
    total = sums.agg(F.sum("g").alias("g"), F.sum("b").alias("b")).first()
    if not total["g"]:
        return np.inf
    higher = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    lost, caught = (
        F.coalesce(F.sum(c).over(higher), F.lit(0)) + F.col(f"{c[0]}_above") for c in ("good", "bad"))
    edges = per.join(F.broadcast(bins), F.col("bin") == F.col("_bin")).select("score", lost.alias("lost"), caught.alias("caught"))
    gain = F.col("caught") / max(1, total["b"]) - F.col("lost") / total["g"]
    allowed = edges.where(F.col("lost") <= (1 - keep_good) * total["g"])  # holds for the highest score
    best = allowed.agg(F.max(F.struct(gain.alias("gain"), "score")).alias("best")).first()["best"]["score"]
    following = per.where(F.col("score") > best).agg(F.min("score").alias("score")).first()["score"]
    return (best + (best if following is None else following)) / 2


def fit_forest(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Forest | None:
    """Grow and calibrate on every labelled document that the base rules pass: the good ones are
    dealt into halves by a hash of the id, one for each step."""
    named = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    one = named.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the statistics come first, so that the join moves a few numbers of a text
    told = docs.where("doc_id is not null").select("doc_id", rule_statistics(F.col(text_col)).alias("s"))
    told = told.groupBy("doc_id").agg(F.min("s").alias("s"))  # of rows with one id always the same
    good = (F.col("quality") == 1).cast("bigint")
    rows = staged(
        told.join(one, "doc_id").select("s.*", good.alias("good"), (F.xxhash64("doc_id") % 2 == 0).alias("half")).where(~_base_failed()),
        "quality-labelled",
    )
    fine = F.col("good") == 1
    n = rows.agg(F.count_if(fine).alias("good"), F.count_if(fine & F.col("half")).alias("half")).first()
    if not n["good"]:
        return None
    halves = 0 < n["half"] < n["good"]
    grown_on = fine & F.col("half") if halves else fine
    forest = random_trees(*_box(rows))
    forest.path = path_lengths(_counted(rows.where(grown_on), forest))
    forest.norm = max(1.0, float(_expected(n["half"] if halves else n["good"])))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, batch in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x)), batch["good"]], ["score", "good"])

    held = rows.where(~grown_on) if halves else rows
    forest.limit = calibrate(held.mapInArrow(scored, "score double, good bigint"))
    return forest


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _verdict(forest: Forest | None, row: Column) -> Column:
    if forest is None:
        return F.lit(True)

    @F.arrow_udf("boolean")
    def usual(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = features(np.column_stack([batch.field(i).to_numpy(zero_copy_only=False) for i in range(len(_NAMES))]))
            yield pa.array(forest.score(x) <= forest.limit, pa.bool_())

    return usual(row)


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS``, ``base_failed`` and ``kept``."""
    forest = fit_forest(docs, labels, text_col)
    s = fresh(docs, "stats")
    told = docs.withColumn(s, rule_statistics(F.col(text_col)))
    told = told.withColumns({"kept": _verdict(forest, F.col(s))} | {c: F.col(f"{s}.{c}") for c in COUNTS}).drop(s)
    return told.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("kept"))
