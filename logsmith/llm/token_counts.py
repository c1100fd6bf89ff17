"""Token counts: batch encoding in Arrow functions that returns lengths only.

The tokenizer drops white space before it merges anything, so every white-space run is a safe
boundary: the count of a text is the sum of the counts of its white-space separated chunks.
Each Arrow batch is cut into sub-batches balanced by UTF-8 bytes; the chunks of a sub-batch
that were not counted before are encoded in one library call, and only their lengths are kept.

Defined results: null and empty texts and texts of white space count 0; a text without any
white space is one chunk and is encoded whole; ties, repeated rows and extra columns pass
through; an existing column with the name of the result is replaced.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsmith.llm.common import by_bytes

#: Unicode white space as the tokenizer's ``\s`` has it (without the separators U+001C-U+001F).
_CHUNK = re.compile("[^\t\n\x0b\x0c\r \x85\xa0  -     　]+")
_INFO_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters after which a full stop or comma starts a new piece in every version of Unicode.
_CUT_AFTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
#: UTF-8 bytes of a sub-batch; bytes of counted chunks kept in a worker's memory (twice that at
#: most); the longest chunk kept.
SUB_BATCH_BYTES = 1 << 20
MEMO_BYTES = 32 << 20
MEMO_CHARS = 48
#: Bytes of an entry beside its key's characters: key and value objects and their slots.
ENTRY_BYTES = 160

_MODELS: dict[str, tuple] = {}


class Memo(dict):
    """Results of the most recently met keys, in two generations: a young generation of ``most``
    bytes becomes the old one, and what is still asked for moves up."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: not known
        self.keep(key, value, len(key))
        return value

    def keep(self, key, value, size: int) -> None:
        """Hold a result of about ``size`` bytes beside an entry's own."""
        self.held += size + ENTRY_BYTES
        if self.held > self.most:  # in place, so that nobody goes on with the old generation
            self.old.clear()
            self.old.update(self)
            self.clear()
            self.held = size + ENTRY_BYTES
        self[key] = value


def chunks(text: str) -> list[str]:
    """The white-space separated chunks of a text (``str.split`` also splits at U+001C-U+001F,
    which the tokenizer counts as symbols)."""
    return _CHUNK.findall(text) if _INFO_SEPARATORS.search(text) else text.split()


def _lowered(text: str) -> str:
    """The text in the tokenizer's own normal form where normalising it again changes nothing
    (so that equal words meet in the memo), else unchanged."""
    if "<|" in text or "Σ" in text:  # special strings are matched as written; Σ by context
        return text
    low = unicodedata.normalize("NFC", text).lower()
    return low if unicodedata.is_normalized("NFC", low) else text


def _model(path: str) -> tuple:
    """One tokenizer and one memo per worker process and file."""
    if path not in _MODELS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _MODELS[path] = tokenizer, Memo(MEMO_BYTES)
    return _MODELS[path]


def _safe_cut(chunk: str) -> str:
    """The part of a chunk before its last full stops and commas, where the tokenizer parts the
    two whatever comes before: after a letter of a chunk that is in normal form already. Else
    the whole chunk (``İ,`` ends in a combining mark once it is lowered)."""
    core = chunk.rstrip(".,")
    if len(core) == len(chunk) or not core or not _CUT_AFTER.match(core[-1]):
        return chunk
    return core if unicodedata.normalize("NFC", chunk).lower() == chunk else chunk


def _count_group(texts: list[str], path: str) -> list[int]:
    tokenizer, memo = _model(path)
    split = [chunks(_lowered(t)) if t else [] for t in texts]
    counts: dict[str, int] = {}  # of this group's chunks
    cut, new = [], set()
    for chunk in set().union(*split):
        try:
            counts[chunk] = memo[chunk]
        except KeyError:
            core = _safe_cut(chunk)
            if core is not chunk:
                cut.append((chunk, core, chunk[len(core) :]))
                new |= {core, chunk[len(core) :]}
            else:
                new.add(chunk)
    for part in new - counts.keys():
        if part in memo or part in memo.old:
            counts[part] = memo[part]
    for group in by_bytes((c for c in new if c not in counts), SUB_BATCH_BYTES):
        for chunk, e in zip(group, tokenizer.encode_batch_fast(group, add_special_tokens=False)):
            counts[chunk] = len(e)
            if len(chunk) <= MEMO_CHARS:
                memo.keep(chunk, len(e), len(chunk))
    for chunk, core, tail in cut:
        counts[chunk] = counts[core] + counts[tail]
        if len(chunk) <= MEMO_CHARS:
            memo.keep(chunk, counts[chunk], len(chunk))
    return [sum(map(counts.__getitem__, words)) for words in split]


def count_tokens(text: Column, tokenizer_path: str) -> Column:
    """The number of tokens of each whole text (long), without added special tokens. The
    tokenizer file must be at ``tokenizer_path`` on every worker; it must normalise to NFC and
    lower case, drop white space and end a word where letters end (as word-level byte BPE
    files do)."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[int] = []
            for group in by_bytes((x.as_py() for x in batch), SUB_BATCH_BYTES):
                out += _count_group(group, tokenizer_path)
            yield pa.array(out, pa.int64())

    return counted(text)


def with_token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    return df.withColumn(out_col, count_tokens(F.col(text_col), tokenizer_path))
