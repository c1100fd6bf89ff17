"""BPE encoding and decoding for a vocabulary file with word ends.

Encoding: a text is cut at special strings, normalised (NFC, white space, lower case), split
into words by the file's pattern, and each word's bytes become a doubly linked list of
symbols. A priority queue holds the merge ranks of adjacent symbols; a popped entry whose two
symbols are no longer the ones it was made for is stale and skipped. Decoding concatenates the
vocabulary strings of the ids, with the one blank between two tokens that the file's missing
decoder stands for.

White space never reaches a word, and words are merged independently of each other, so the ids
of frequent words are kept in a memo per worker that is bounded in bytes. Texts are decoded from
their ids alone.

Defined results: null and empty texts have no ids and decode to the empty string; texts of any
length are taken whole; ties, repeated rows and extra columns pass through; columns with the
names of the results (``n_tokens``, ``token_ids``, ``decoded_text``) are replaced, others stay.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from logsmith.llm.common import fresh
from logsmith.llm.token_counts import Memo

#: Bytes of merged words kept in a worker's memory (twice that at most) and the longest one kept.
MEMO_BYTES = 24 << 20
MEMO_CHARS = 40
#: Texts of an output batch: ids are longer than texts.
OUT_ROWS = 256
#: A word pattern, and what it is for texts of ASCII and Latin letters alone, where the standard
#: library's faster engine has the same classes. Files with another pattern use their own.
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NOT_LATIN = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-ɏ]")
_LATIN_WORDS = re.compile(
    r"[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r A-Za-z0-9À-ÖØ-öø-ɏ]+"
)

_MODELS: dict[str, WordBpe] = {}


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    shown = set(printable)
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file (``model`` type BPE, byte-level symbols)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)
        }
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        self.added = added
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.fast = _LATIN_WORDS if split["pattern"]["Regex"] == _KNOWN_PATTERN else self.words
        self.bytes = _byte_symbols()
        self.shown = {str(i): t for i, t in self.tokens.items()}
        self.memo = Memo(MEMO_BYTES)

    def word_ids(self, word: str) -> list[int]:
        """Merge one normalised word, lowest rank first and leftmost among equal ranks."""
        symbols = [self.bytes[b] for b in word.encode()]
        symbols[-1] += self.suffix
        ids = [self.vocab.get(s, -1) for s in symbols]
        if -1 in ids:  # the file names no unknown token: such symbols have no id
            ids = [i for i in ids if i >= 0]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two was merged meanwhile
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((joined, ids[k])):
                    heapq.heappush(queue, (m[0], i, joined, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], joined))):
                heapq.heappush(queue, (m[0], h, ids[h], joined, m[1]))
        return [i for i in ids if i >= 0]

    def _normal(self, piece: str) -> str:
        piece = unicodedata.normalize("NFC", piece)
        # one character at a time where the context would matter (final sigma)
        return "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()

    def _split(self, piece: str) -> list[str]:
        piece = self._normal(piece)
        return (self.words if _NOT_LATIN.search(piece) else self.fast).findall(piece)

    def _word(self, word: str) -> str:
        """The ids of a word that the young generation of the memo does not know."""
        try:
            return self.memo[word]
        except KeyError:
            ids = " ".join(map(str, self.word_ids(word)))
            if len(word) <= MEMO_CHARS:
                self.memo.keep(word, ids, len(word) + len(ids))
            return ids

    def encode(self, text: str) -> str:
        """The ids of a text as decimals joined by blanks."""
        known, meet = self.memo.get, self._word
        at, parts = 0, []
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            parts += [known(w) or meet(w) for w in self._split(text[at : m.start()])]
            parts.append(str(self.added[m[0]]))
            at = m.end()
        parts += [known(w) or meet(w) for w in self._split(text[at:] if at else text)]
        return " ".join(filter(None, parts))

    def decode(self, ids: str) -> str:
        """The vocabulary strings of ids (decimals joined by blanks), joined by blanks; unknown
        ids have none."""
        parts = ids.split(" ") if ids else []
        try:
            return " ".join(map(self.shown.__getitem__, parts))
        except KeyError:
            return " ".join(self.shown[i] for i in parts if i in self.shown)


def model(path: str) -> WordBpe:
    """One model per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def _n_ids(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def bpe_encode(text: Column, path: str) -> Column:
    """``struct<n_tokens long, ids array<int>>`` of each whole text."""

    @F.arrow_udf("struct<n_tokens: bigint, ids: array<int>>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = model(path)
        for batch in batches:
            ids = [[int(i) for i in bpe.encode(x.as_py() or "").split()] for x in batch]
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.StructArray.from_arrays([n, pa.array(ids, pa.list_(pa.int32()))], ["n_tokens", "ids"])

    return encoded(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of each array of ids; null ids decode to the empty string."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = model(path)
        for batch in batches:
            yield pa.array([bpe.decode(" ".join(map(str, x.as_py() or []))) for x in batch], pa.string())

    return decoded(ids)


def bpe_round_trip(text: Column, path: str) -> Column:
    """``struct<n_tokens long, ids string, decoded string>``: the ids as decimals joined by
    blanks, and what these ids decode to."""

    @F.arrow_udf("struct<n_tokens: bigint, ids: string, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = model(path)
        for batch in batches:
            for at in range(0, len(batch), OUT_ROWS):
                ids = [bpe.encode(x.as_py() or "") for x in batch.slice(at, OUT_ROWS)]
                columns = [
                    pa.array(map(_n_ids, ids), pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array(map(bpe.decode, ids), pa.string()),
                ]
                yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids", "decoded"])

    return both(text)


def with_bpe(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``token_ids`` (decimals joined by blanks) and ``decoded_text``."""
    made = fresh(df, "bpe")
    results = {"n_tokens": F.col(f"{made}.n_tokens"), "token_ids": F.col(f"{made}.ids"), "decoded_text": F.col(f"{made}.decoded")}
    return df.withColumn(made, bpe_round_trip(F.col(text_col), path)).withColumns(results).drop(made)
