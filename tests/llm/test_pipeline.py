"""The pipeline against its stages' plain versions, and the registered queries."""

import brute
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
from logsmith.llm import queries, simhash

SF_SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES) and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, docs.collect()
    judged = {r.doc_id: r.kept for r in queries.op6_quality(spark, SF_SMALL).collect()}
    rows = {r.doc_id: r for r in kept if judged[r.doc_id]}
    texts = {d: t for d, (t, _, _) in brute.dedup_lines([(d, r.text) for d, r in rows.items()]).items()}
    groups = brute.simhash_components(list(texts.items()))
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    hits = brute.contamination(list(texts.items()), items)
    texts = {d: t for d, t in texts.items() if not hits[d][1]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id: r.token_ids for r in out} == {d: " ".join(map(str, ids)) for d, ids in want.items()}
    assert 0 < len(out) < len(kept)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == columns, name


def test_near_duplicate_stage_broadcasts_no_probes(spark, monkeypatch):
    plans, links = [], simhash.links

    def planned(*args):
        found = links(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "links", planned)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, f"a text of some words {i // 2}", "en", "s", 3) for i in range(40)], schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        left = corpus_pipeline.near_duplicate_stage(spark, docs, SF_SMALL).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    groups = brute.simhash_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in left) == sorted({c for _, c in groups.values()}) and len(left) <= 20
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_stages_take_nulls_and_empty_tables(spark, tmp_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_dir}/{table}.parquet")
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, None, None, None), (None, words, "en", "s", 3), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tmp_dir)
            assert out.count() <= len(data), name
        docs.write.parquet(f"{tmp_dir}/{len(data)}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{tmp_dir}/{table}.parquet").write.parquet(f"{tmp_dir}/{len(data)}/{table}.parquet")
        ids = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_dir}/{len(data)}").collect()}
        assert ids == ({1, None} if data else set())  # the copy without an id lost its only line
