"""Approximate nearest neighbours against a scan of all vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsmith.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    """Exact neighbours: (query, rank) -> (id, score)."""
    good = [
        (i, np.array(v, np.float32).astype(np.float64))
        for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    lengths = [len(v) for _, v in good]
    most = min(sorted(set(lengths)), key=lambda n: -lengths.count(n), default=0)
    good = [x for x in good if len(x[1]) == most]
    out = []
    matrix = np.array([v for _, v in good])
    for n, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            scores = ann.exact_scores(v, matrix)
            ranked = sorted((-scores[j], good[j][0] is None, good[j][0] or 0) for j in range(len(good)) if j != n)[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def found(rows, every, k, **more):
    return sorted((tuple(r) for r in ann.nearest(rows, every, k, **more).collect()), key=repr)


def recall(got, want):
    pairs = {(q, i) for q, _, i, _ in want}
    return len(pairs & {(q, i) for q, _, i, _ in got}) / len(pairs)


def cloud(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, d)).astype(np.float32))]


def test_one_leaf_is_exact_with_ties_copies_and_rows_that_take_no_part(frame):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]  # many ties
    rows += [(i, [1.0, 2.0, 0.0]) for i in range(100, 160)]  # copies
    rows += [(20, [1.0, 2.0, 0.0])] * 2 + [(40, [0.5, 0.5, 0.5])]  # repeated ids and rows
    rows += [(None, [1.0, 2.0, 0.0]), (None, [2.0, 2.0, 2.0])]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 1.0]), (280, [1.0, math.nan, 1.0]),
             (300, [1.0, math.inf, 1.0]), (320, [1.0, 1.0]), (340, [9.0] * 4)]
    assert found(frame(rows, SCHEMA), 20, 5, leaf_size=1000) == brute(rows, 20, 5)


def test_every_leaf_visited_is_exact(frame):
    rows = cloud(400)
    assert found(frame(rows, SCHEMA), 20, 7, target=1.0, leaf_size=16, block_rows=50)[:50] == brute(rows, 20, 7)[:50]


@pytest.mark.parametrize("spread", [1.0, 8.0])
def test_recall_on_random_and_clustered_vectors_of_different_lengths(frame, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * spread
    rows = [(i, (centres[i % 30] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = found(frame(rows, SCHEMA), 20, 20, leaf_size=32, block_rows=200), brute(rows, 20, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    exact = {(q, i): s for q, _, i, s in brute(rows, 20, 3000)}
    assert all(s == exact[q, i] for q, _, i, s in got)  # scores are the measure itself
    for q in {q for q, *_ in got}:
        mine = sorted((r, s, i) for p, r, i, s in got if p == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda x: (-x[1], x[2]))


def test_few_leaves_suffice_for_clusters(spark, frame):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16)) * 20
    rows = [(i, (centres[i % 60] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(6000)]
    points = ann._points(frame(rows, SCHEMA).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 20, 10)
    forest = ann.fit_forest(points, 4, 32, 60_000)
    routed = ann._routed(points, spark.sparkContext.broadcast(forest))
    visits, part = ann.measured_visits(routed, forest, 10, 0.95, 64)
    leaves = sum(int((t.leaf >= 0).sum()) for t in forest.trees)
    assert part >= 0.95 and visits < leaves / 4


def test_a_third_of_equal_vectors(frame):
    rows = cloud(600, 4) + [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(300)]
    got, want = found(frame(rows, SCHEMA), 20, 20, leaf_size=40), brute(rows, 20, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    for q in range(1000, 1300, 20):  # copies are found through their one point, smallest ids first
        ids = [i for _, p, i in sorted((r, p, i) for p, r, i, _ in got if p == q) if i >= 1000]
        assert ids == [i for i in range(1000, 1300) if i != q][: len(ids)] and ids


def test_fewer_rows_than_asked_one_row_and_empty_tables(frame):
    assert found(frame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], SCHEMA), 20, 20) == [(0, 1, 1, 4.0)]
    assert found(frame([(0, [1.0, 2.0])], SCHEMA), 20, 20) == []
    assert found(frame([], SCHEMA), 20, 20) == []
    assert found(frame([(0, None)], SCHEMA), 20, 20) == []


def test_other_columns_do_not_matter(frame):
    rows = cloud(50)
    more = {c: F.lit("x") for c in ("id", "vec", "point", "leaves", "rank", "score", "block")}
    assert found(frame(rows, SCHEMA).withColumns(more), 20, 5) == brute(rows, 20, 5)
