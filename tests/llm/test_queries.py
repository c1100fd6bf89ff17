"""The registered queries against DuckDB where SQL has them, else against brute force."""

import hashlib
import os

import brute
import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logsmith.llm import queries
from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    rows, wanted = [tuple(r) for r in df.collect()], cur.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(rows) == len(wanted)
    assert digest(df.columns, rows)[0] == digest(columns, wanted)[0]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_counts_and_bpe(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs.items()}
    for r in queries.QUERIES["op1_token_counts"](spark, SF).collect():
        n = len(ids[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 2048)
    for r in queries.QUERIES["op8_bpe"](spark, SF).collect():
        own = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), sha(" ".join(map(str, own))))
        assert r.decoded_sha256 == sha(library.decode(own, skip_special_tokens=False))


def test_simhash(spark, docs):
    want = brute.simhash_components(list(docs.items()))
    got = queries.QUERIES["op4_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_quality(spark, docs):
    got = queries.QUERIES["op6_quality"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        counts = brute.quality_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and not (r.base_failed and r.kept)


def test_repeated_substrings(spark, docs):
    want = brute.repeated_bytes(list(docs.items()), 400)
    for r in queries.QUERIES["op7_suffix_dedup"](spark, SF).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, sha(kept))


def test_toxicity_on_held_out_rows(spark):
    """Accuracy on labelled rows that training did not see (the larger sf0.1 has enough)."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op9_toxicity"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    toxic = [r.predicted for r in got if labels[r.doc_id] == 1]
    clean = [r.predicted for r in got if labels[r.doc_id] == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_quality_verdicts_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op6_quality"](spark, sf).collect() if labels.get(r.doc_id) is not None]
    good = [r.kept for r in got if labels[r.doc_id] == 1 and not r.base_failed]
    bad = [r.kept for r in got if labels[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
