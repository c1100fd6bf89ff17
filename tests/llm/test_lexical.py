"""Ranked lexical search against a direct computation."""

import random
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsmith.llm import lexical

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def words(text):
    cut = "".join(c if c in LETTERS or ord(c) >= 0x80 else " " for c in text or "")
    return "".join(c.lower() if c.isascii() else c for c in cut).split(" ")


def terms(text):
    return [w for w in words(text) if w]


def brute(docs, items, k=10):
    vectors = [(i, terms(t)) for i, t in docs]
    vectors = [(i, w) for i, w in vectors if w]
    n, length = len(vectors), sum(len(w) for _, w in vectors)
    df = Counter(w for _, ws in vectors for w in set(ws))
    by_item = {}
    for item, text in set(items):
        by_item.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in by_item.items():
        found = []
        for doc, ws in vectors:
            tf = Counter(ws)
            m = 25 + (75 * len(ws) * n) // length
            score = sum(
                c * floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
                for w, c in wanted.items()
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=repr)


def ranked(docs, items, **more):
    return sorted((tuple(r) for r in lexical.rank_documents(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(3000)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(n)]


ITEMS = [(1, "w1 w2 w3 w17 w17 w90"), (2, "W5, w8; w399!"), (3, "unknown"), (4, ""), (5, None), (None, "w7 w44 w3"), (1, "w250 w1"), (2, "W5, w8; w399!")]


def test_equals_direct_computation(frame):
    docs = corpus(900)
    docs += [(i + 5000, docs[7][1]) for i in range(300)]  # a third are copies of one document
    docs += [(None, docs[9][1]), (None, None), (6001, None), (6002, ""), (6003, " .,"), (7, docs[7][1]), (6004, "w1 " * 50_000 + "é w399")]
    assert ranked(frame(docs), frame(ITEMS, "item_id long, text string")) == brute(docs, ITEMS)


def test_blocks_of_items_give_the_same(frame):
    docs = corpus(200, 1)
    items = [(i, t) for i, t in corpus(40, 2)]
    out = ranked(frame(docs), frame(items, "item_id long, text string"), block_bytes=500, k=3)
    assert out == brute(docs, items, 3)


def test_fewer_documents_than_asked_and_frequent_terms(frame):
    docs = [(1, "a b"), (2, "a"), (3, "a c a")]  # every document holds a: weight zero
    assert ranked(frame(docs), frame([(1, "a b"), (2, "a")], "item_id long, text string")) == brute(docs, [(1, "a b"), (2, "a")])


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_tables(frame, docs, items):
    assert ranked(frame(docs), frame(items, "item_id long, text string")) == []


def test_other_columns_do_not_matter(frame):
    docs, items = corpus(50), [(1, "w1 w2 w90")]
    more = {c: F.lit("x") for c in ("item", "n", "m", "terms", "score", "rank", "v")}
    out = ranked(frame(docs).withColumns(more), frame(items, "item_id long, text string").withColumns(more))
    assert out == brute(docs, items)


def test_branch_and_bound_leaves_out_documents_and_loses_none():
    rng = np.random.default_rng(3)
    vectors, ms, ids = [], rng.integers(30, 300, 4000), list(range(4000))
    for _ in range(4000):
        ranks = np.unique(np.minimum(rng.geometric(0.02, 25) - 1, 299))
        vectors.append((ranks, rng.integers(1, 6, len(ranks))))
    counted = [Counter(rng.integers(100, 300, 4).tolist()) for _ in range(20)]
    weights = [100 + 30 * r for r in range(300)]
    items = lexical.Items.of(counted, list(range(300)), weights)
    best = lexical.Best(20, 5)
    scored = lexical.search(lexical.Trie(ids, ms, vectors, bucket=8), items, best)
    assert scored < 4000
    for number, wanted in enumerate(counted):
        scores = []
        for i, (ranks, tfs) in enumerate(vectors):
            tf = dict(zip(ranks.tolist(), tfs.tolist()))
            s = sum(c * weights[t] * lexical.part(tf.get(t, 0), int(ms[i])) for t, c in wanted.items())
            if s > 0:
                scores.append((-s, i))
        assert best.kept[number] == sorted(scores)[:5]


def test_nested_and_equal_paths_keep_the_trie_shallow():
    vectors = [(np.arange(i % 600 + 1), np.ones(i % 600 + 1, np.int64)) for i in range(2400)]
    trie = lexical.Trie(list(range(2400)), np.full(2400, 50), vectors)

    def depth(node):
        return 1 + max(map(depth, node.kids), default=0)

    def ends(node):
        return [(node.start, node.end)] if not node.kids else [e for kid in node.kids for e in ends(kid)]

    assert depth(trie.root) < 30
    spans = ends(trie.root)
    assert spans[0][0] == 0 and spans[-1][1] == 2400 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
