"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Fitting: the trees are fitted on a bounded sample of the distinct vectors. A split is the
hyperplane between two random members, at the median of the members' projections. Vectors get
one more component that makes their lengths equal, so that nearness by angle is nearness by
inner product.

Indexing: every distinct vector is routed to a leaf of each tree. A leaf's vectors lie in blocks
of bounded size, small leaves share one.

Searching: a query takes the leaves of all trees from one priority queue, the least distance
beyond the hyperplanes on the way first, up to a number of leaves that is measured: for a
bounded sample of queries the exact neighbours are computed over all vectors, and the smallest
number that finds ``target`` of them is used. In random data that is a large part of the leaves,
in clustered data a small one. Each block gets its queries with the leaves that they want,
computes inner products and keeps the nearest of each query.

Reranking: the kept candidates are ranked by the inner product in double precision, summed over
the components always in the same order.

Equal vectors are one point of the index with the smallest ids of its rows: no more of them can
stand among the ``k`` nearest, since ties go by id. Queries that are equal are searched once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do vectors of another length than the most common one (the smaller of equally
common ones); a row is not its own neighbour, while another row with its id or vector may be; a
null id cannot be a query and comes last among ties; an empty table has no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsmith.llm.common import staged

#: Neighbours of a query and trees of the forest.
K = 20
TREES = 4
#: Vectors that the trees are fitted on (and bytes of them), members of a leaf among these.
SAMPLE_ROWS = 65_536
SAMPLE_BYTES = 64 << 20
LEAF = 64
#: Queries whose exact neighbours set the number of leaves, and the part to be found of them.
MEASURED_QUERIES = 128
TARGET = 0.95
#: Vectors of a block, and queries that a task handles at a time.
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Queries whose nearest a task holds before it lets them go.
HELD_QUERIES = 50_000
#: A vector that has more than one query in so many is joined with its results by broadcast.
HOT_SHARE = 1000
_SEED = 42


@dataclass
class Tree:
    """Nodes in preorder: hyperplane, children and, for leaves, their number (else -1)."""

    normals: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), np.int64)
        todo = np.flatnonzero(self.leaf[at] < 0)
        while len(todo):
            node = at[todo]
            beyond = np.einsum("ij,ij->i", points[todo], self.normals[node]) > self.cuts[node]
            at[todo] = np.where(beyond, self.right[node], self.left[node])
            todo = todo[self.leaf[at[todo]] < 0]
        return self.leaf[at]


def fit_tree(points: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    normals, cuts, left, right, leaf = [], [], [], [], []
    leaves = 0

    def grow(members: np.ndarray) -> int:
        nonlocal leaves
        me = len(leaf)
        for column, value in ((normals, np.zeros(points.shape[1])), (cuts, 0.0), (left, -1), (right, -1), (leaf, -1)):
            column.append(value)
        if len(members) > leaf_size:
            a, b = points[rng.choice(members, 2, replace=False)]
            length = np.linalg.norm(a - b)
            normal = (a - b) / length if length else rng.normal(size=len(a))
            along = points[members] @ normal
            cut = float(np.median(along))
            beyond = along > cut
            if beyond.any():
                normals[me], cuts[me] = normal, cut
                left[me] = grow(members[~beyond])
                right[me] = grow(members[beyond])
                return me
        leaf[me] = leaves
        leaves += 1
        return me

    grow(np.arange(len(points)))
    return Tree(np.array(normals), np.array(cuts), np.array(left), np.array(right), np.array(leaf))


@dataclass
class Forest:
    trees: list[Tree]
    longest: float  # length of the longest vector

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Index points: one more component brings all vectors to one length."""
        rest = self.longest**2 - np.einsum("ij,ij->i", vectors, vectors)
        return np.column_stack([vectors, np.sqrt(np.maximum(rest, 0))])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree (vectors x trees)."""
        points = self.lifted(vectors)
        return np.column_stack([t.route(points) for t in self.trees])

    def visits(self, vectors: np.ndarray, most: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the first ``most`` (tree, leaf) from the shared priority queue."""
        points = np.column_stack([vectors, np.zeros(len(vectors))])
        size = np.linalg.norm(points, axis=1, keepdims=True)
        points = points / np.where(size, size, 1) * self.longest
        shape = [(t.left.tolist(), t.right.tolist(), t.leaf.tolist()) for t in self.trees]
        for start in range(0, len(points), 64):
            margins = [points[start : start + 64] @ t.normals.T - t.cuts for t in self.trees]
            for i in range(len(margins[0])):
                margin = [m[i].tolist() for m in margins]
                queue = [(0.0, k, 0) for k in range(len(shape))]
                found: list[tuple[int, int]] = []
                while queue and len(found) < most:
                    cost, k, node = heapq.heappop(queue)
                    left, right, leaf = shape[k]
                    beyond = margin[k]
                    while leaf[node] < 0:
                        d = beyond[node]
                        near, far = (right[node], left[node]) if d > 0 else (left[node], right[node])
                        heapq.heappush(queue, (cost + d * d, k, far))
                        node = near
                    found.append((k, leaf[node]))
                yield found


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.ascontiguousarray(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _lists(rows: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed alone (the same in every batch)."""
    return (vectors * query).sum(axis=1)


def _nearest(query: np.ndarray, rough: np.ndarray, vectors: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the ``k`` nearest by (score, smallest id); ``rough`` are the products
    as the matrix multiplication rounds them."""
    picked = np.arange(len(rough))
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        slack = 1e-9 * max(1.0, float(np.abs(rough).max()))
        picked = np.flatnonzero(rough >= least - slack)
    scores = exact_scores(query, vectors[picked])
    order = np.lexsort((first[picked], -scores))[:k]
    return scores[order], picked[order]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _points(rows: DataFrame, every: int, k: int) -> DataFrame:
    """Distinct vectors: ``point`` (a number), ``vec``, ``ids`` (the smallest ``k + 1`` of its
    rows, null last) and ``asked`` (number of its rows that are queries)."""
    first = Window.partitionBy("vec").orderBy(F.asc_nulls_last("id"))
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)  # few rows per task reach the shuffle
    few = few.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("_ids"))
    few = few.select(F.col("vec").alias("_vec"), F.transform("_ids", lambda x: x["id"]).alias("ids"))
    asked = rows.groupBy("vec").agg(F.count_if(F.col("id") % every == 0).alias("asked"))
    out = asked.join(few, F.col("vec") == F.col("_vec")).drop("_vec")
    first = F.coalesce(F.col("ids")[0], F.lit(2**63 - 1))  # null last
    return staged(out.withColumns({"point": F.monotonically_increasing_id(), "first": first}), "ann-points")


def fit_forest(points: DataFrame, trees: int, leaf_size: int, sample_rows: int) -> Forest | None:
    """Trees over the sample of ``points`` that comes first by a hash of the vector."""
    shape = points.agg(F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    if shape[0] is None:
        return None
    most = max(leaf_size, min(sample_rows, SAMPLE_BYTES // (8 * shape[0])))
    sample = points.select("vec").orderBy(F.xxhash64("vec"), "point").limit(most).toArrow()
    vectors = _matrix(sample.column("vec").combine_chunks())
    forest = Forest([], float(np.sqrt(shape[1])))
    lifted = forest.lifted(vectors)
    rng = np.random.default_rng(_SEED)
    forest.trees = [fit_tree(lifted, leaf_size, rng) for _ in range(trees)]
    return forest


def _routed(points: DataFrame, forest: Broadcast) -> DataFrame:
    """``points`` with ``leaves``, the leaf of each tree."""

    @F.arrow_udf("array<int>")
    def leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _lists(list(forest.value.leaves(_matrix(batch)))) if len(batch) else pa.array([], pa.list_(pa.int32()))

    return points.withColumn("leaves", leaves(F.col("vec").cast("array<double>")))


def _exact(points: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> dict[int, list[list[int]]]:
    """For each of a bounded set of queries the leaves of its exact ``k`` nearest other points."""
    spark = points.sparkSession
    asked = spark.sparkContext.broadcast((np.array([p for p, _ in queries]), np.array([v for _, v in queries])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, vectors = asked.value
        best: list[list] = [[] for _ in numbers]
        for batch in batches:
            points, leaves = batch.column("point").to_numpy(), batch.column("leaves").to_pylist()
            rough = vectors @ _matrix(batch.column("vec")).T
            for q, row in enumerate(rough):
                take = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else range(len(row))
                found = best[q] + [(-float(row[i]), int(points[i]), leaves[i]) for i in take if points[i] != numbers[q]]
                best[q] = heapq.nsmallest(k, found)
        rows = [(int(n), -s, p, lv) for n, kept in zip(numbers, best) for s, p, lv in kept]
        n, s, p, lv = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(p, pa.int64()), pa.array(lv, pa.list_(pa.int32()))],
            names=["q", "score", "point", "leaves"],
        )

    found = points.select("point", F.col("vec").cast("array<double>").alias("vec"), "leaves").mapInArrow(
        scan, "q bigint, score double, point bigint, leaves array<int>"
    )
    order = Window.partitionBy("q").orderBy(F.desc("score"), "point")
    near = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    out: dict[int, list[list[int]]] = {}
    for r in near.select("q", "leaves").collect():  # k rows for each measured query
        out.setdefault(r["q"], []).append(r["leaves"])
    return out


def measured_visits(points: DataFrame, forest: Forest, k: int, target: float, queries: int) -> tuple[int, float]:
    """The least number of leaves that finds ``target`` of the exact neighbours of a sample of
    queries, and the part that it found."""
    total = sum(int((t.leaf >= 0).sum()) for t in forest.trees)
    rows = points.where("asked > 0").orderBy(F.xxhash64("point"), "point").limit(queries).select("point", "vec").collect()
    if not rows or total <= len(forest.trees):
        return total, 1.0
    sample = [(r["point"], np.array(r["vec"], np.float64)) for r in rows]
    near = _exact(points, sample, k)
    needed: list[int] = []  # visits after which each neighbour is met
    for (point, _), visits in zip(sample, forest.visits(np.array([v for _, v in sample]), total)):
        place = {v: i + 1 for i, v in enumerate(visits)}
        needed += [min(place[t, leaf] for t, leaf in enumerate(leaves)) for leaves in near.get(point, [])]
    if not needed:
        return total, 1.0
    needed.sort()
    enough = needed[min(len(needed), int(np.ceil(target * len(needed)))) - 1]
    return enough, float(np.mean(np.array(needed) <= enough))


def _placement(points: DataFrame, forest: Forest, block_rows: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """First block and number of blocks of each leaf of each tree, and the number of all blocks:
    neighbouring small leaves share a block, a large leaf has several."""
    pairs = points.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    counts = [np.zeros(int((t.leaf >= 0).sum()), np.int64) for t in forest.trees]
    for r in pairs.collect():  # a row per leaf of the fitted trees
        counts[r["tree"]][r["leaf"]] = r["count"]
    firsts, numbers, block = [], [], 0
    for of_tree in counts:
        first, number, held = np.zeros(len(of_tree), np.int64), np.ones(len(of_tree), np.int64), 0
        for leaf, n in enumerate(of_tree.tolist()):
            if held and held + n > block_rows:
                block, held = block + 1, 0
            first[leaf], number[leaf] = block, max(1, -(-n // block_rows))
            held += n
            if number[leaf] > 1:
                block, held = block + int(number[leaf]), 0
        block += 1
        firsts.append(first)
        numbers.append(number)
    return firsts, numbers, block


#: What travels to the blocks: index points (``kind`` 0) with one leaf, and query points
#: (``kind`` 1) with the leaves of the block that they visit.
_SENT = "block bigint, kind int, point bigint, first bigint, vec array<{kind}>, leaves array<int>"


def _sent_rows(forest: Broadcast, placement: Broadcast, most: int):
    """A copy of each point for the block of its leaf in every tree, and one of each query point
    for every block in which it visits leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, numbers = placement.value
        bases = np.concatenate([[0], np.cumsum([len(f) for f in firsts])])  # leaves of all trees in one numbering
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors, point = _matrix(batch.column("vec")), batch.column("point").to_numpy()
                leaves = np.array(batch.column("leaves").to_pylist())
                rows: list[tuple[int, int, int, list[int]]] = []  # block, kind, row of the batch, leaves
                for t in range(len(firsts)):
                    here = firsts[t][leaves[:, t]] + point % numbers[t][leaves[:, t]]
                    rows += [(int(b), 0, i, [int(bases[t] + leaf)]) for i, (b, leaf) in enumerate(zip(here, leaves[:, t]))]
                asked = np.flatnonzero(batch.column("asked").to_numpy() > 0)
                for i, visits in zip(asked, forest.value.visits(vectors[asked], most)):
                    wanted: dict[int, list[int]] = {}
                    for t, leaf in visits:
                        for b in range(firsts[t][leaf], firsts[t][leaf] + numbers[t][leaf]):
                            wanted.setdefault(b, []).append(int(bases[t] + leaf))
                    rows += [(int(b), 1, int(i), found) for b, found in wanted.items()]
                for a in range(0, len(rows), 4096):
                    block, kind, row, found = zip(*rows[a : a + 4096])
                    row = pa.array(row)
                    columns = [batch.column(c).take(row) for c in ("point", "first", "vec")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block, pa.int64()), pa.array(kind, pa.int32()), *columns, _lists(list(map(np.array, found)))],
                        names=["block", "kind", "point", "first", "vec", "leaves"],
                    )

    return run


class Block:
    """The index points of a block, by leaf."""

    def __init__(self, parts: list[tuple]):
        self.point, self.first, self.vectors, leaf = map(np.concatenate, zip(*parts))
        order = np.argsort(leaf, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)
        self.of_leaf = {int(leaf[g[0]]): g for g in groups}

    def search(self, queries: np.ndarray, vectors: np.ndarray, leaves: list[list[int]], best: "Best") -> None:
        """Offer the nearest among the wanted leaves of each query."""
        rough = vectors @ self.vectors.T
        for i, wanted in enumerate(leaves):
            parts = [self.of_leaf[x] for x in wanted if x in self.of_leaf]
            if parts:
                here = np.concatenate(parts)
                scores, picked = _nearest(vectors[i], rough[i, here], self.vectors[here], self.first[here], best.k)
                here = here[picked]
                best.offer(int(queries[i]), scores, self.first[here], self.point[here])


class Best:
    """The ``k`` nearest points of each query over all blocks that a task has searched."""

    def __init__(self, k: int):
        self.k = k
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def offer(self, query: int, scores: np.ndarray, first: np.ndarray, point: np.ndarray) -> None:
        if (known := self.of.get(query)) is not None:
            if len(known[0]) == self.k:
                able = scores >= known[0][-1]
                if not able.any():
                    return
                scores, first, point = scores[able], first[able], point[able]
            new = ~np.isin(point, known[2])  # other trees find the same points
            scores, first, point = (np.concatenate([a, b[new]]) for a, b in zip(known, (scores, first, point)))
        order = np.lexsort((point, first, -scores))[: self.k]
        self.of[query] = scores[order], first[order], point[order]

    def taken(self) -> Iterator[pa.RecordBatch]:
        """All that is held, some queries a batch; nothing is held afterwards."""
        held, self.of = list(self.of.items()), {}
        for a in range(0, len(held), QUERY_ROWS):
            part = held[a : a + QUERY_ROWS]
            q = np.repeat(np.array([x for x, _ in part], np.int64), [len(x[0]) for _, x in part])
            scores, first, point = (np.concatenate([x[c] for _, x in part]) for c in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(point), pa.array(first), pa.array(scores)], names=["q", "point", "first", "score"]
            )


def _searched(k: int):
    """Rows sorted by (block, kind): the points of a block are held, its queries stream by. What
    a query finds in the blocks of one task is combined before it leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, block, best = None, [], None, Best(k)
        for batch in batches:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)]):
                if numbers[a] != number:
                    number, parts, block = numbers[a], [], None
                for c in range(a, b, QUERY_ROWS):
                    rows = batch.slice(c, min(QUERY_ROWS, b - c))
                    point, vectors, leaves = rows.column("point").to_numpy(), _matrix(rows.column("vec")), rows.column("leaves")
                    if kinds[a] == 0:
                        parts.append((point, rows.column("first").to_numpy(), vectors, leaves.flatten().to_numpy()))
                    elif parts or block:
                        block, parts = block or Block(parts), []
                        block.search(point, vectors, leaves.to_pylist(), best)
                        if len(best.of) >= HELD_QUERIES:
                            yield from best.taken()
        yield from best.taken()

    return run


def nearest(rows: DataFrame, every: int, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES,
            leaf_size: int = LEAF, sample_rows: int = SAMPLE_ROWS, target: float = TARGET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its
    ``k`` nearest found among all other rows, nearest first, ties to the smaller id."""
    spark = rows.sparkSession
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where(_usable(F.col("vec")))
    sizes = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if sizes:
        usable = usable.where(F.size("vec") == sizes[0]["n"])
    points = _points(usable, every, k)
    forest = fit_forest(points, trees, leaf_size, sample_rows)
    if forest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(forest)  # no more than the sample allows
    points = staged(_routed(points, shared), "ann-routed")
    visits, _ = measured_visits(points, forest, k, target, MEASURED_QUERIES)
    firsts, numbers, blocks = _placement(points, forest, block_rows)
    placement = spark.sparkContext.broadcast((firsts, numbers))
    sent = points.select("point", "first", "vec", "leaves", "asked").mapInArrow(
        _sent_rows(shared, placement, visits), _SENT.format(kind=kind)
    )
    tasks = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = sent.repartition(tasks, "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(_searched(k + 1), "q bigint, point bigint, first bigint, score double")
    # at most k + 1 points of each task; a point that several trees found has one score
    by_point = Window.partitionBy("q").orderBy(F.desc("score"), "first", "point")
    found = found.withColumn("_n", F.dense_rank().over(by_point)).where(F.col("_n") <= k + 1).dropDuplicates(["q", "point"])
    single = found.join(points.select("point", "ids"), "point").select(
        "q", "score", F.explode("ids").alias("id"), (F.col("q") == F.col("point")).alias("own")
    )
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "own")
    single = single.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    lists = single.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_n", "score", "id", "own"))).alias("near"))
    lists = staged(lists.join(points.select(F.col("point").alias("q"), "vec", "asked"), "q"), "ann-found")
    return _answered(usable.where(F.col("id") % every == 0), lists, k)


def _answered(queries: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """The list of its vector for every query row, without the row itself."""
    hot_from = (lists.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]) // HOT_SHARE + 1
    lists = lists.withColumnRenamed("vec", "_vec")
    hot = F.broadcast(lists.where(F.col("asked") > hot_from))  # fewer than HOT_SHARE rows
    names = hot.select(F.col("_vec").alias("_hot"))
    rare = queries.join(F.broadcast(names), F.col("vec") == F.col("_hot"), "left_anti")
    of_rare = rare.join(lists.where(F.col("asked") <= hot_from), F.col("vec") == F.col("_vec"))
    joined = queries.join(hot, F.col("vec") == F.col("_vec")).unionByName(of_rare)
    # the row itself: the first entry of its own vector with its id
    own = F.array_position(F.transform("near", lambda x: F.coalesce(x["own"] & (x["id"] == F.col("id")), F.lit(False))), F.lit(True))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("_own")), 1, k)
    out = joined.withColumn("_own", own).select(F.col("id").alias("query_id"), F.posexplode(others).alias("_p", "x"))
    return out.select("query_id", (F.col("_p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
