"""Line dedup, SimHash, repeated substrings, decontamination, WARC, quality rules."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from logsmith.llm import common, components, decontam, induced, line_dedup, quality, simhash, suffix_dedup, warc


def _edited(rng, line):
    i = rng.randint(0, len(line) - 1)
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("éxß ") + line[i:], line[:i] + "ñ" + line[i + 1 :]])


def _line_docs(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randint(18, 90))) for _ in range(25)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = _edited(rng, line)
            lines.append(line)
        docs.append((i, "\n".join(lines + rng.choice([[], ["short"], [""]]))))
    return docs


@pytest.mark.parametrize("few", [True, False])
def test_lines_within_one_edit(frame, monkeypatch, few):
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    docs = [*_line_docs(4 + few), (900, None), (901, ""), (902, "z" * 5000 + "\n" + "z" * 4999 + "\n" + "z" * 4998)]
    df = frame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_lines int, line string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == brute.dedup_lines(docs)


def test_line_ties_and_null_ids(frame):
    line, near = "the quick brown fox jumps", "the quick brown fax jumps"
    df = frame([(5, line), (5, line), (None, line), (None, near), (7, f"{near}\nown line, only in this one")])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(False, 5, line), (False, 5, line), (False, 7, "own line, only in this one"), (True, 0, ""), (True, 0, "")]
    assert line_dedup.dedup_lines(frame([])).count() == 0


def test_short_and_blank_lines(frame):
    docs = [(1, "ab\n\nab\n \t\nabc"), (2, "abc\n\n \t\nabd\nThe end."), (3, "The end.\nthe end.\n\x1c\n\x1c"), (4, "ab")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(docs)).collect()}
    assert got == brute.dedup_lines(docs) and got[1] == ("ab\n\n \t\nabc", 5, 1) and got[4] == ("", 1, 1)


def test_line_dedup_has_no_python_in_its_plan(frame):
    plan = line_dedup.dedup_lines(frame(_line_docs(1, 5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in loops}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _near_docs(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 200, 400]))]
        for k in range(4):
            copy = list(base)
            for _ in range(k):
                copy[rng.randint(0, len(copy) - 1)] = rng.choice(words)
            docs.append((i * 10 + k, " ".join(copy).upper() if k == 1 else "\t".join(copy)))
    return [*docs, (700, None), (701, ""), (702, " \n"), (703, "é à\x85b　c d")]


def test_simhash_groups(frame):
    docs = _near_docs(6)
    out = simhash.near_duplicates(frame([(d, t, 0) for d, t in docs], "doc_id long, text string, fp int"))
    got = {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out.collect()}
    want = brute.simhash_components(docs)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_simhash_links_are_exact(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(4):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for bits in (0, 1, 3):
        got = {frozenset((r.u, r.v)) for r in simhash.links(df, bits).collect()}
        want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
        assert got == want
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_simhash_joins_broadcast_nothing_that_grows_with_the_documents(spark, frame):
    """However small the files look: what explode adds to them is in no estimate."""
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    prints = common.staged(spark.range(3000).select(F.xxhash64("id").alias("fp")), "test-prints")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        linked, grouped = planned(simhash.links(prints)), planned(simhash.near_duplicates(frame(_near_docs(6))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in linked and "Broadcast" not in linked
    assert "SortMergeJoin" in grouped and "Broadcast" not in grouped


def test_simhash_representatives(frame):
    docs = [*_near_docs(9), (701, ""), (None, "only here"), (None, "only here"), (0, _near_docs(9)[0][1])]
    want = brute.simhash_components(dict(d for d in docs if d[0] is not None).items())
    left = simhash.representatives(frame([(d, t, "s") for d, t in docs], "doc_id long, text string, fp string"))
    assert left.columns == ["doc_id", "text", "fp"]
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()}) and ids.count(None) == 1
    assert simhash.near_duplicates(frame([])).count() == simhash.representatives(frame([])).count() == 0


def _repeat_docs(seed, size=24):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [make(rng.randint(size - 4, 5 * size)) for _ in range(6)]
    docs = [(i, make(rng.randint(0, 60)) + rng.choice(passages) * rng.randint(1, 2) + make(rng.randint(0, 60))) for i in range(50)]
    return [*docs, (90, None), (91, ""), (92, "ab" * 200), (93, "x" * 300), (94, make(size - 1))]


@pytest.mark.parametrize("shard_bytes", [8 << 20, 2000, 60])
def test_repeated_bytes(frame, shard_bytes):
    docs = _repeat_docs(shard_bytes)
    df = frame([(d, t, "c") for d, t in docs], "doc_id long, text string, kept string")
    out = suffix_dedup.remove_repeats(df, depth=24, shard_bytes=shard_bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    assert got == brute.repeated_bytes(docs, 24)


def test_groups_larger_than_a_shard_are_cut_again(frame, monkeypatch):
    rounds = []
    spans = suffix_dedup._spans
    monkeypatch.setattr(suffix_dedup, "_spans", lambda rows, depth, grams, size: rounds.append(grams[0]) or spans(rows, depth, grams, size))
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefg") for _ in range(n))
    passage, tail = make(22), make(10)
    docs = [(i, make(20) + passage + (tail if i % 5 == 0 else make(rng.randint(0, 9)))) for i in range(300)]
    docs += [(1000 + i, make(i % 7) + "z" * (30 + i)) for i in range(40)]
    got = suffix_dedup.remove_repeats(frame(docs), depth=24, shard_bytes=600)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()} == brute.repeated_bytes(docs, 24)
    assert rounds == [4, 12, 18, 23, 24]


def test_repeated_rows_and_empty_tables_of_substrings(frame):
    text = "abcdefghij" + "klmnopqrst" * 3
    rows = frame([(1, text), (1, text), (None, "0123456789" + text[:30]), (None, "0123456789")])
    got = sorted((r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(rows, depth=24).collect())
    assert got == [(0, 0, b"0123456789"), (0, 30, b"0123456789"), (1, 40, b""), (1, 40, b"")]
    assert suffix_dedup.remove_repeats(frame([])).count() == 0


def test_regions_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 500)
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(3000))
    starts = [s + k for _, s, n, _ in suffix_dedup.regions(text, 60) for k in range(n)]
    assert starts == list(range(3000 - 59))


def test_induced_sorting_finds_repeats_with_files():
    rng = random.Random(4)
    for _ in range(150):
        alphabet, depth = rng.choice([b"ab", b"a", bytes(range(256))]), rng.choice([2, 3, 8, 20])
        base = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        regions = [rng.choice([base * rng.randint(1, 3), bytes(rng.choice(alphabet) for _ in range(30)), base[rng.randint(0, len(base) - 1) :]]) for _ in range(5)]
        texts = {i: r for i, r in enumerate(regions)}
        count = {}
        for r in texts.values():
            for i in range(len(r) - depth + 1):
                count[r[i : i + depth]] = count.get(r[i : i + depth], 0) + 1
        want = [[i for i in range(len(r) - depth + 1) if count[r[i : i + depth]] > 1] for r in regions]
        for budget in (200, 1 << 20):
            assert [s.tolist() for s in induced.repeated_starts(regions, depth, budget)] == want


def _contaminated(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "d3lta", "eps", "zeta"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice([",", ".", "", "\n"]) for _ in range(n))
    items = [(i, say(rng.randint(11, 30))) for i in range(12)] + [(50, "one Short item"), (51, "solo"), (52, ""), (53, None), (50, "another short"), (None, "no id here")]
    docs = [(i, say(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "").upper() + " " + say(rng.randint(0, 40))) for i in range(40)]
    return docs + [(90, None), (91, ""), (92, "solo"), (93, "!!"), (94, "one short, ITEM; no id here")], items


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination(frame, monkeypatch, block):
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 64)
    docs, items = _contaminated(7)
    out = decontam.find_contamination(
        frame([(d, t, 3) for d, t in docs], "doc_id long, text string, n_words int"), frame(items, "item_id long, text string"), block_bytes=block
    )
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out.collect()} == brute.contamination(docs, items)
    assert all(sum(s.end - s.start for s in r.hit_spans) == r.n_hit for r in out.collect())


def test_contamination_of_empty_tables(frame):
    none = frame([], "item_id long, text string")
    assert [tuple(r)[2:] for r in decontam.find_contamination(frame([(1, "a b")]), none).collect()] == [(2, 0, [], [])]
    assert decontam.find_contamination(frame([]), none).count() == 0


def test_shift_tables_skip_and_confirm():
    (table,) = decontam.compile_patterns([("i", b"a b c d e f g h i j k")], 10)
    assert table.shift[(b"i", b"j")] == 0 and table.shift[(b"a", b"b")] == 8 and table.furthest == 9
    assert [s for s, _ in table.occurrences(b"x a b c d e f g h i j k".split())] == [1, 2]


PAGES = [(1, "u", "<p>x</p>"), (2, "u\r\nX: y", "<p>x</p>"), (3, None, None), (4, "é", ""), (9, "u", "ü" * 9000), (5, "u", "ü" * 9000), (6, "u", "z")]


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 600, "file_bytes": 300}])
def test_archives_read_back(spark, frame, tmp_dir, limits):
    df = frame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.write_warc(df, f"{tmp_dir}/a", **limits)
    got = warc.read_warc(spark, f"{tmp_dir}/a")
    assert {tuple(r)[:5] for r in got.collect()} == brute.warc_rows([(p, h) for p, _, h in PAGES])
    assert {r.target_uri for r in got.collect()} == {"u", "u%0D%0AX: y", "", "é"}
    warc.write_warc(df.repartition(5), f"{tmp_dir}/b", **limits)  # other partitions, same bytes
    files = [spark.read.parquet(f"{tmp_dir}/{k}/manifest").orderBy("file").collect() for k in "ab"]
    assert files[0] == files[1] and len(files[0]) >= (3 if limits else 1)


def test_archive_ties_and_small_payloads(spark, frame, tmp_dir):
    schema = "page_id long, url string, html string"
    df = frame([(1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (2, "v", "tiny")], schema)
    rows = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    assert rows == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1), (2, "response", None)]
    assert {r.record_type for r in warc.archive_pages(df, min_revisit_bytes=5).collect()} == {"response"}
    assert warc.archive_pages(frame([], schema)).count() == 0


def test_damaged_archives_are_noticed(spark, frame, tmp_dir):
    warc.write_warc(frame([(1, "u", "body")], "page_id long, url string, html string"), f"{tmp_dir}/c")
    (name,) = [r.file for r in spark.read.parquet(f"{tmp_dir}/c/manifest").collect()]
    with open(f"{tmp_dir}/c/{name}", "r+b") as f:
        f.truncate(f.seek(0, 2) - 20)
    with pytest.raises(Exception, match="truncated"):
        warc.read_warc(spark, f"{tmp_dir}/c").collect()


TEXTS = [None, "", "one two", "a b c d e f g h " * 4, "x\ny\nx\n \n \nx", "Ünï #*$ | <a> & %", "w " * 50, "a b c d e f g h i a b c d e f g h j"]


def test_quality_counts(frame):
    rng = random.Random(0)
    texts = TEXTS + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = frame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    for r in quality.judge(df, frame([], "doc_id long, quality int, toxic int")).collect():
        counts = brute.quality_counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r.kept != r.base_failed  # no labels: no forest


def test_forest_tells_junk_from_prose(frame):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 120))]
        bad = i % 6 == 0
        docs.append((i, " ".join(w + "%%%" if bad and rng.random() < 0.5 else w for w in words)))
        labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (700, 0, 0), (3, None, None), (1, 1, 0)]
    kept = {r.doc_id: r.kept for r in quality.judge(frame(docs), frame(labels, "doc_id long, quality int, toxic int")).collect()}
    good = [kept[i] for i in range(600) if i % 6]
    assert np.mean(good) > 0.98 and not any(kept[i] for i in range(0, 600, 6))


def test_forest_rejects_a_rare_kind_of_junk(frame):
    """Unbroken blobs are 6 of 100 bad rows; the others differ in symbols only."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(700):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 120))]
        blob = i >= 600 or i % 6 == 0 and i < 36
        if blob:
            words = [w * 40 for w in words]
        elif i % 6 == 0:
            words = ["%" * len(w) if rng.random() < 0.5 else w for w in words]
        docs.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, int(i % 6 > 0), 0))
    kept = {r.doc_id: r.kept for r in quality.judge(frame(docs), frame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([kept[i] for i in range(600) if i % 6]) > 0.98
    assert not any(kept[i] for i in range(600, 700)) and not any(kept[i] for i in range(0, 600, 6))


def test_repeated_windows_agree_with_counting():
    rng = random.Random(9)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        assert quality.repeated_words(words) == brute.quality_counts(" ".join(w.decode() for w in words))[4]


def test_forest_counts_every_labelled_row(frame, monkeypatch):
    """Every good row is in a cell of every tree or among the rows of the threshold, however many
    there are; the threshold is the one of an exhaustive search."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40)) for _ in range(300)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(300)]
    grown, held = [], []
    count, calibrate = quality._counted, quality.calibrate
    monkeypatch.setattr(quality, "_counted", lambda rows, f: grown.append(count(rows, f)) or grown[-1])
    monkeypatch.setattr(quality, "calibrate", lambda scores: held.extend(scores.collect()) or calibrate(scores))
    forest = quality.fit_forest(frame(list(enumerate(texts))), frame(labels, "doc_id long, quality int, toxic int"))
    passed = [i for i, t in enumerate(texts) if 100 * brute.quality_counts(t)[4] <= 30 * brute.quality_counts(t)[0]]
    per_tree = set(grown[0].sum(1).tolist())
    assert len(per_tree) == 1 and per_tree.pop() + len(held) == len(passed)
    good, bad = ([r.score for r in held if r.good == g] for g in (1, 0))
    found = []
    for edge in sorted({r.score for r in held}):
        lost = sum(s > edge for s in good)
        if lost <= (1 - quality.KEEP_GOOD) * len(good):
            found.append((sum(s > edge for s in bad) / len(bad) - lost / len(good), edge))
    best = max(found)[1]
    assert best <= forest.limit < min([s for s in good + bad if s > best], default=np.inf)


def test_path_ends_at_a_node_with_one_row():
    counts = np.zeros((1, 1 << quality.DEPTH), np.int64)
    counts[0, 0], counts[0, -1] = 5, 1
    path = quality.path_lengths(counts)[0]
    assert path[0] == quality.DEPTH + quality._expected(5) and path[-1] == 1 and path[1] == quality.DEPTH
    assert path[(1 << quality.DEPTH) // 2 - 1] == 2
