"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: terms (whole words, and word beginnings that stand for inflected forms)
that occur in toxic training rows and hardly in others. Its trie, intersected with the
Levenshtein automaton of one edit, is a deterministic automaton whose states (sets of trie node
and edits made) are built when first met; a word runs through it once and dies early unless it
is a term or one edit away from a whole-word term. Each hit is seen in its window of words:
quotation marks, reporting words and a second person there, and further hits, separate
quotation from abuse. A logistic regression, fitted on the training rows, turns the sums of
the windows into a score.

Labels enter by the training rows only; language, source and id are not inputs of a score.

Defined results: null and empty texts have no hits and get the score of a text without hits;
texts are taken whole; a repeated or null id is scored like any other row; without training
rows of both labels every score is 0; extra columns pass through, columns named like the
results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logsmith.llm.common import utf8

#: Training rows at most, of each label (the first by a hash of the id). Each stands for as many
#: rows as its label has of them, in the shares of terms and in the fit.
TRAINING_ROWS = 8_000
#: A term is in at least this many toxic training rows, this share of the rows that have it is
#: toxic (counted as if a quarter clean row more had it), and the lower bound of that share, so
#: many standard errors down (Wilson), is above the share of toxic rows in the sample.
MIN_TOXIC_ROWS = 4
MIN_SHARE = 0.9
STANDARD_ERRORS = 4.0
#: Candidate terms at most, best first, and the lengths of word beginnings that are tried.
MAX_TERMS = 2_000
STEM_CHARS = (4, 5, 6, 7)
#: A beginning has to be in so many times the toxic rows of its most frequent single word.
INFLECTED = 1.5
#: Words of a shingle by which copies among the training texts are met.
SHINGLE_WORDS = 5
#: Whole words from this length on are also met with one edit.
FUZZY_CHARS = 5
WINDOW = 6
THRESHOLD = 0.3

_WORD = re.compile(r"[\w@$!*]+(?:['’-][\w@$!*]+)*")
_STRIP = "!*_"
_QUOTES = re.compile("[\"“”„«»‹›‘]")
_REPORTING = frozenset("said says wrote called quoted quote word term dit écrit sagte schrieb dijo escribió".split())
_SECOND = frozenset("you your you're u ya du dich dir dein ihr tu te toi vous votre tú ti usted tus".split())
#: The state of a word whose beginning was met: the rest is free.
_FREE = frozenset({(-1, 0)})
#: Words kept as known to be no hit, per worker.
_MEMO_WORDS = 400_000


class LexiconAutomaton:
    """The trie of the terms, intersected with the automaton of at most one edit."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[bool] = [False]
        self.stem_at: list[bool] = [False]
        self.fuzzy_at: list[bool] = [False]
        for term in words:
            node = self._insert(term)
            self.word_at[node] = True
            self.fuzzy_at[node] = len(term) >= FUZZY_CHARS
        for term in stems:
            self.stem_at[self._insert(term)] = True
        # nodes on the way to a term that may be met with an edit
        self.leads = [False] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):  # children have larger numbers
            self.leads[node] = self.fuzzy_at[node] or any(self.leads[c] for c in self.children[node].values())
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})
        self.dead = self._state(set())

    def _insert(self, term: str) -> int:
        node = 0
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word_at.append(False)
                self.stem_at.append(False)
                self.fuzzy_at.append(False)
            node = self.children[node][c]
        return node

    def _state(self, pairs: set) -> int:
        whole = set(pairs)
        for node, edits in pairs:  # a character of the term that the word lacks
            if not edits:
                whole.update((c, 1) for c in self.children[node].values() if self.leads[c])
        return self._numbered(frozenset(p for p in whole if not (p[1] and (p[0], 0) in whole)))

    def _numbered(self, key: frozenset) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, char: str) -> int:
        out = set()
        for node, edits in self.states[state]:
            if node < 0 or (not edits and self.stem_at[node]):
                out.add((-1, 0))
                break
            to = self.children[node].get(char)
            if to is not None and (not edits or self.leads[to]):
                out.add((to, edits))
            if not edits and self.leads[node]:
                out.add((node, 1))  # a character too many
                out.update((c, 1) for c in self.children[node].values() if self.leads[c])  # another one
        to = self._numbered(_FREE) if (-1, 0) in out else self._state(out)
        self.moves[state][char] = to
        return to

    def match(self, word: str) -> int:
        """2: a term (or an inflected form of a beginning), 1: one edit from a term, 0: neither."""
        state, moves, dead = self.start, self.moves, self.dead
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == dead:
                return 0
        best = 0
        for node, edits in self.states[state]:
            if node < 0 or (not edits and (self.word_at[node] or self.stem_at[node])):
                return 2
            if edits and self.fuzzy_at[node]:
                best = 1
        return best


@dataclass
class Scorer:
    """Lexicon and weights; the automaton is built where it runs."""

    words: list[str]
    stems: list[str]
    weights: np.ndarray | None = None
    _automaton: LexiconAutomaton | None = field(default=None, repr=False)
    _clean: set = field(default_factory=set, repr=False)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights, "_automaton": None, "_clean": set()}

    def hits(self, words: list[str]) -> list[tuple[int, int]]:
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.words, self.stems)
        clean, match, out = self._clean, self._automaton.match, []
        if len(clean) > _MEMO_WORDS:
            clean.clear()
        for w in set(words).difference(clean):
            if kind := match(w.strip(_STRIP)):
                out.append((w, kind))
            else:
                clean.add(w)
        if not out:
            return []
        kinds = dict(out)
        return [(i, kinds[w]) for i, w in enumerate(words) if w in kinds]

    def features(self, text: str) -> list[float]:
        """Sums over the windows around the hits of a text."""
        low = text.lower()
        words = _WORD.findall(low)
        found = self.hits(words)
        exact = fuzzy = quoted = reported = addressed = close = 0
        if found:
            spans = [m.span() for m in _WORD.finditer(low)]
            for k, (i, kind) in enumerate(found):
                a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
                before, after = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
                around = words[a:b]
                in_quotes = bool(_QUOTES.search(before)) and bool(_QUOTES.search(after))
                reporting = not _REPORTING.isdisjoint(around)
                exact += kind == 2
                fuzzy += kind == 1
                quoted += in_quotes
                reported += reporting
                addressed += not _SECOND.isdisjoint(around)
                close += k + 1 < len(found) and found[k + 1][0] - i <= WINDOW
        n = np.log1p(len(words))
        counts = np.log1p([exact, fuzzy, quoted, reported, addressed, close])
        return [float(exact > 0), float(fuzzy > 0), float(quoted > 0), float(reported > 0), *counts.tolist(), exact / (1 + n), fuzzy / (1 + n)]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1:] @ np.array(self.features(text or "")), -30, 30))))


N_FEATURES = 12


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, counted: np.ndarray | None = None) -> np.ndarray:
    """Intercept and weights by Newton steps on the ridge-penalised likelihood; ``counted``: how
    often each row counts."""
    z = np.column_stack([np.ones(len(x)), x])
    counted = np.ones(len(x)) if counted is None else counted
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (counted * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (counted * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _texts(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """The texts of ``rows`` (bounded), one of each group that shares its least shingle: words
    of a text that was copied often would look like terms."""

    @F.arrow_udf("long")
    def least_shingle(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch:
                words = x.as_py().split()
                shingles = zip(*(words[i:] for i in range(SHINGLE_WORDS))) if len(words) > SHINGLE_WORDS else [words]
                out.append(min(xxhash.xxh64_intdigest(b" ".join(s)) for s in shingles) >> 1)
            yield pa.array(out, pa.int64())

    met = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(rows), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")  # the same one in every run
    return met.groupBy(least_shingle(utf8("text")).alias("least"), "toxic").agg(one).select("one.text", "toxic")


def _terms(text: Column) -> Column:
    """The distinct words of a text, and the beginnings of its longer words (marked ``*``)."""

    @F.arrow_udf("array<string>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                words = {w.strip(_STRIP) for w in _WORD.findall((x.as_py() or "").lower())}
                words = {w for w in words if len(w) > 2}
                rows.append(list(words | {w[:n] + "*" for w in words for n in STEM_CHARS if len(w) > n}))
            yield pa.array(rows, pa.list_(pa.string()))

    return terms(text)


def learn_lexicon(sample: DataFrame, stands_for: dict[int, float]) -> tuple[list[str], list[str]]:
    """Words and word beginnings of the training rows (text, toxic) that tell toxic ones, a row
    of each label counted as the rows it stands for. Terms are counted in Spark; at most
    ``MAX_TERMS`` come back."""
    met = sample.select("toxic", F.explode(_terms(F.col("text"))).alias("term"))
    counted = met.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    chance = sample.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = stands_for[1] * F.col("bad")
    share = toxic / (toxic + stands_for[0] * (F.col("n") - F.col("bad") + 0.25))
    n, p, z2 = F.col("n"), F.col("bad") / F.col("n"), STANDARD_ERRORS**2
    lower = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    likely = counted.where((F.col("bad") >= MIN_TOXIC_ROWS) & (share >= MIN_SHARE) & (lower > chance))
    bad = {r["term"]: r["bad"] for r in likely.orderBy(F.desc("bad"), "term").limit(MAX_TERMS).collect()}
    words = [t for t in bad if not t.endswith("*")]
    stems: list[str] = []
    for term in sorted((t for t in bad if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = term[:-1]
        # a beginning counts if it stands for more than one word, and no shorter one stands for it
        if not any(map(stem.startswith, stems)) and bad[term] > INFLECTED * max((bad[w] for w in words if w.startswith(stem)), default=0):
            stems.append(stem)
    return sorted(w for w in words if not any(map(w.startswith, stems))), stems


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: int = TRAINING_ROWS) -> Scorer:
    """Learn from ``labels`` (training rows only) of at most ``most`` rows of each label, at the
    shares that the labels have in all of them."""
    named = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    one = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda t: one.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = _texts(docs, first(1).unionByName(first(0)), text_col)
    rows_of = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    stands_for = {t: max(1.0, rows_of.get(t, 0) / most) for t in (0, 1)}
    words, stems = learn_lexicon(sample, stands_for)
    scorer = Scorer(words, stems)

    @F.arrow_udf("array<double>")
    def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scorer.features(x.as_py() or "") for x in batch], pa.list_(pa.float64()))

    rows = sample.select("toxic", seen("text").alias("x")).toPandas()  # at most 2 x ``most`` rows of N_FEATURES numbers
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["toxic"][i], tuple(rows["x"][i])))]  # sums in one order
    y = rows["toxic"].to_numpy(np.float64)
    if len(set(y.tolist())) == 2:
        counted = np.where(y == 1, stands_for[1], stands_for[0])
        scorer.weights = fit_logistic(np.stack(rows["x"].to_list()), y, counted=counted * len(y) / counted.sum())
    return scorer


def with_toxicity(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int)."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scorer.score(x.as_py()) for x in batch], pa.float64())

    out = docs.withColumn("score", scored(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
