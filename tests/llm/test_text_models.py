"""Token counts, BPE and chat formatting against the tokenizer library; toxicity."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsmith.llm import bpe, chat, token_counts, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    None, "", "  \n\t", "Hello, World's 1984!!", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>",
    "ΟΔΥΣΣΕΥΣ ΑΣ Σ", "İstanbul ǅ ﬁ ½ ²", "a\x1cb \x1d c", "é ́a xͅ ẖ H̱", "日本語 テスト 각", "it's I'LL we'Ve 'S ''s",
    "　x\x85y z", "🤦🏽‍♂️ok", "\x01\x02", "a,b. c,. d.,", "word" * 500, "x" * 3000,
]


def _random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = ["aA", "é", "É", "ß", "Σ", "ς", "'s", "T", "12", "½", "́", "<|endoftext|>", "\t", " ", "\n", ".,", "!?", "日", "ñ", "don't"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(n)]


TEXTS = ODD + _random_texts(300, 3)


def test_counts_and_round_trip_are_those_of_the_library(frame):
    library = Tokenizer.from_file(WORD_BPE)
    df = frame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    counted = {r.doc_id: r.n_tokens for r in token_counts.with_token_counts(df, WORD_BPE).collect()}
    coded = {r.doc_id: r for r in bpe.with_bpe(df, WORD_BPE).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert counted[i] == coded[i].n_tokens == len(ids), repr(text)
        assert coded[i].token_ids == " ".join(map(str, ids))
        assert coded[i].decoded_text == library.decode(ids, skip_special_tokens=False)


def test_encode_then_decode_columns(frame):
    library = Tokenizer.from_file(WORD_BPE)
    df = frame([(i, t) for i, t in enumerate(TEXTS[:60])])
    out = df.withColumn("e", bpe.bpe_encode(F.col("text"), WORD_BPE)).withColumn("d", bpe.bpe_decode(F.col("e.ids"), WORD_BPE))
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.e.ids == ids and r.e.n_tokens == len(ids)
        assert r.d == library.decode(ids, skip_special_tokens=False)


def test_memo_is_bounded_by_bytes_and_keeps_what_is_asked_for():
    entry = token_counts.ENTRY_BYTES
    memo = token_counts.Memo(3 * (entry + 1))
    for key in "abc":
        memo.keep(key, key.upper(), 1)
    assert memo.old == {} and len(memo) == 3
    memo.keep("d", "D", 1)  # the three become the old generation
    assert dict(memo) == {"d": "D"} and memo["a"] == "A" and "a" in memo
    for i in range(100):
        memo.keep(str(i), i, 1)
        assert memo["d" if i == 0 else str(i)] and memo.held <= memo.most
        assert len(memo) + len(memo.old) <= 6
    with pytest.raises(KeyError):
        memo["z"]


ODD_LETTERS = [
    "Σ", "İ", ",", ".", "a", "B", "é", "ı", "ß", "ſ", "'s", "'", "t", "1", "²", "<|endoftext|>", "<|", "|>", " ", "\n", "　", "\x1c",
    "\u0307", "\u0301", "e", "漢", "😀", "ﬁ", "Ǆ", "ŉ", "ʼ", "n't", "_", "-", "ό", "Ά", "ᾳ", "\u200d", "ﷺ", "ģ", "ʰ", "x", "Y",
]


def test_random_strings_have_the_counts_and_ids_of_the_library():
    library = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(1)
    texts = ["Σ İ,", "a <|x|> İSTANBULİ."] + ["".join(rng.choices(ODD_LETTERS, k=rng.randint(1, 14))) for _ in range(40_000)]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    counted = [n for at in range(0, len(texts), 500) for n in token_counts._count_group(texts[at : at + 500], WORD_BPE)]
    assert [(t, n) for t, n, e in zip(texts, counted, wanted) if n != len(e)] == []
    coder = bpe.model(WORD_BPE)
    for text, e in zip(texts, wanted):
        ids = coder.encode(text)
        assert ids == " ".join(map(str, e.ids)), text
        assert coder.decode(ids) == library.decode(e.ids, skip_special_tokens=False), text


def test_a_small_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 500)
    small, library = bpe.WordBpe(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    text = " ".join(f"word{i % 37} x{i}" for i in range(3000))  # one text that would fill any memo
    assert small.encode(text) == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
    assert small.memo.held <= 500


def test_another_word_pattern_is_the_files_own(tmp_path):
    import json

    with open(WORD_BPE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = "it's 1984!! don't a1b2"
    assert bpe.WordBpe(str(path)).encode(text) == " ".join(map(str, Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids))


def test_batches_are_balanced_by_bytes():
    from logsmith.llm.common import by_bytes

    assert [len(g) for g in by_bytes(["漢" * 10] * 6, 60)] == [2, 2, 2]
    assert [len(g) for g in by_bytes(["a" * 10, None, "b" * 100, b"c"], 60)] == [2, 1, 1]


def test_input_columns_with_inner_names_stay(frame):
    df = frame([(1, "a b", "kept")], "doc_id long, text string, bpe string")
    assert bpe.with_bpe(df, WORD_BPE).first().bpe == "kept"


def test_counts_of_an_empty_table(frame):
    assert token_counts.with_token_counts(frame([]), WORD_BPE).count() == 0
    assert bpe.with_bpe(frame([]), WORD_BPE).count() == 0


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<\\s>", "\\[INST]\\", "<|endoftext|>", "[", "<", "a\\nb", "", None, "[[INST]]</s></s>", "日本[/INST]語"]


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(5)
    pieces = [*chat.CONTROL, "\\", "[", "<", "a", "\n", "日"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)


def test_conversations_read_back(frame):
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(HOSTILE)]
    rows += [(2, 0, None, "x"), (2, 0, None, "x"), (2, None, "assistant", "first"), (None, 1, "assistant", "y" * 5000), (3, 0, "a[/INST]\nb", "z")]
    df = frame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_conversations(df, BYTE_BPE)
    out = {r.conv_id: r for r in made.withColumn("b", chat.read_back(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(out) == {1, 2, 3, None}
    tokenizer = chat._tokenizer(BYTE_BPE)
    for conv, r in out.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        turns = [(x[2] or "", x[3] or "") for x in own]
        assert chat.parse(r.formatted) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.b.n_turns == len(turns) and r.b.loss_chars == len(loss)
        assert r.b.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.b.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        # the masked tokens spell the escaped assistant texts, one range a turn
        spoken = [tokenizer.decode(r.token_ids[s.first : s.last], skip_special_tokens=False) for s in r.loss_tokens]
        assert spoken == [chat.escape(t) for role, t in turns if role == "assistant"]


def test_no_conversations(frame):
    assert chat.format_conversations(frame([], "conv_id long, turn long, role string, text string"), BYTE_BPE).count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_the_trie_within_one_edit():
    words, stems = ["idiot", "moron", "ab", "clown"], ["lowei", "vequ"]
    automaton, rng = toxicity.LexiconAutomaton(words, stems), random.Random(1)
    for _ in range(8000):
        w = list(rng.choice([*words, *stems, "xyz"]))
        for _ in range(rng.randint(0, 3)):
            k, i = rng.randint(0, 2), rng.randint(0, len(w))
            if k == 0:
                w.insert(i, rng.choice("abcdiomnrtwl"))
            elif i < len(w):
                w[i : i + 1] = [] if k == 1 else [rng.choice("abcdiomnrtwl")]
        w = "".join(w)
        near = any(len(x) >= toxicity.FUZZY_CHARS and _edits(w, x) <= 1 for x in words)
        assert automaton.match(w) == (2 if w in words or any(map(w.startswith, stems)) else int(near)), w


def test_toxicity_learns_terms_and_judges_misspellings(frame):
    rng = random.Random(2)
    plain = ["lorem", "ipsum", "dolor", "amet", "sed", "eius", "tempor", "magna", "quis", "nostrud"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) + str(rng.randint(0, 30)) for _ in range(30)]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randint(0, 29)] = rng.choice(["gribblex", "snorfle"])
        docs.append((i, " ".join(words), 5.0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, "lorem gribblax ipsum", 0.0), (1001, None, 0.0), (1002, "", 0.0), (1003, "amet " * 20000 + "snorfle", 0.0), (None, "SNORFLE!!", 0.0)]
    labels += [(None, 1, 1), (3, None, None)]
    df = frame(docs, "doc_id long, text string, score double")
    scorer = toxicity.train(df, frame(labels, "doc_id long, quality int, toxic int"))
    assert set(scorer.words) == {"gribblex", "snorfle"} and scorer.stems == []
    out = {r.doc_id: r for r in toxicity.with_toxicity(df, scorer).collect()}
    assert all(out[i].predicted == int(i % 8 == 0) for i in range(400))
    assert out[None].predicted == 1 and out[1003].predicted == 1
    assert out[1001].score == out[1002].score < 0.3 and out[1000].score >= out[1002].score


def test_toxicity_without_labels(frame):
    df = frame([(1, "abc")])
    for labels in ([], [(1, 1, 0)]):
        scorer = toxicity.train(df, frame(labels, "doc_id long, quality int, toxic int"))
        assert [r.score for r in toxicity.with_toxicity(df, scorer).collect()] == [0.0]


def test_toxicity_keeps_the_shares_of_the_labels(frame):
    """A bounded sample of each label does not make terms and scores of balanced rows."""
    rng = random.Random(4)
    plain = [f"lorem{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 10 == 0
        words = [rng.choice(plain) for _ in range(12)]
        if toxic:
            words += ["gribblex"] + ["dolorous"] * (i % 20 == 0)
        elif i % 30 == 1:
            words.append("dolorous")  # 150 toxic rows, 100 clean ones
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    df, named = frame(docs), frame(labels, "doc_id long, quality int, toxic int")
    scorer = toxicity.train(df, named, most=200)  # 200 of 300 toxic rows, 200 of 2700 clean ones
    assert scorer.words == ["gribblex"] and scorer.stems == []
    scores = [r.score for r in toxicity.with_toxicity(df, scorer).collect()]
    assert abs(sum(scores) / len(scores) - 0.1) < 0.02  # the share of toxic rows


def test_a_row_counts_as_the_rows_it_stands_for():
    x, y = np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([0.0, 1.0, 0.0, 1.0])
    times = np.array([3, 1, 1, 4])
    whole = toxicity.fit_logistic(np.repeat(x, times, 0), np.repeat(y, times))
    assert np.allclose(toxicity.fit_logistic(x, y, counted=times.astype(float)), whole)


def test_rare_terms_are_learnt_by_evidence(spark):
    """A word of 6 of 800 toxic rows and of no clean one is a term, however many rows there are
    besides; where half the rows are toxic, 6 rows of one label are chance."""
    rows = [(f"lorem ipsum {'gribblex' if i < 6 else 'dolor'}", 1) for i in range(800)]
    for clean, terms in ((3200, ["gribblex"]), (800, [])):
        sample = spark.createDataFrame([*rows, *[("lorem ipsum dolor", 0)] * clean], "text string, toxic int")
        assert toxicity.learn_lexicon(sample, {0: 1.0, 1: 1.0}) == (terms, [])
