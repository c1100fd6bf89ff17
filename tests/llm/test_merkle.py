"""The Merkle manifest against a direct computation."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logsmith.llm import merkle

COLS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def _value(v):
    return b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()


def _leaf(row, more=0):
    return _h(b"".join(_value(row[c] + more if c == "n_chars" and row[c] is not None else row[c]) for c in COLS))


def _levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    rows = [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows]
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r), r))
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        groups[k].sort(key=lambda x: x[:3])
        trees[k] = _levels([x[2] for x in groups[k]])
    top = _levels([trees[k][-1][0] for k in langs])
    out = []
    for i, k in enumerate(langs):
        for j, (_, _, leaf, r) in enumerate(groups[k]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            proof, folded = "", _leaf(r, 1) if hit else leaf
            for levels, p in ((trees[k], j), (top, i)):
                for level in levels[:-1]:
                    other = level[p ^ 1] if (p ^ 1) < len(level) else ""
                    proof += other
                    folded = _h(other + folded if p % 2 else folded + other)
                    p //= 2
            root = top[-1][0]
            out.append((r["doc_id"], leaf, trees[k][-1][0], root, _h(proof), folded, folded == root))
    return sorted(out, key=repr)


def verified(docs, stride=merkle.STRIDE):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    n_chars = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.row_hash("doc_id", "source", "lang", n_chars, "text")
    return sorted((tuple(r) for r in merkle.verify(docs, COLS, "lang", "doc_id", found, stride).collect()), key=repr)


MIXED = (
    [(1, "a", None, "s", 1)] * 5  # repeated rows
    + [(None, None, None, None, None)] * 3
    + [(5, "", "", "", 0), (5, None, "", None, None), (5, "b", "", "s", 1)]  # ties in the order column
    + [(7 * i, "x" * i, f"l{i % 5}", "s", None if i % 3 == 0 else i) for i in range(40)]
    + [(900, "é" * 200_000, "l1", "s", 200_000)]
)


@pytest.mark.parametrize("stride", [1, merkle.STRIDE])
@pytest.mark.parametrize(
    "rows",
    [[], [(1, "a", "en", "s", 1)], MIXED, [(i, "t", f"k{i:03}", "s", 1) for i in range(300)]],
    ids=["empty", "lone", "mixed", "many groups"],
)
def test_equals_direct_computation(frame, rows, stride):
    assert verified(frame(rows, SCHEMA), stride) == (brute(rows) if rows else [])


def test_one_group_of_several_blocks(frame):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(700)]
    assert verified(frame(rows, SCHEMA, parts=7), stride=3) == brute(rows)


def test_other_columns_and_clashing_names_do_not_matter(frame):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(9)]
    docs = frame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "pos", "root", "leaf", "level", "_idx")})
    assert verified(docs) == brute(rows)


def test_any_changed_row_fails_and_only_that_row(frame):
    rows = [(i, f"t{i}", f"l{i % 3}", "s", i) for i in range(50)]
    docs = frame(rows, SCHEMA)
    text = F.when(F.col("doc_id") == 17, "forged").otherwise(F.col("text"))
    out = merkle.verify(docs, ["doc_id", "text"], "lang", "doc_id", merkle.row_hash("doc_id", text))
    assert {r["doc_id"] for r in out.where("not verified").collect()} == {17}


def test_session_settings_are_left_as_they_were(spark, frame):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    verified(frame([(1, "a", "en", "s", 1)], SCHEMA))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == before
