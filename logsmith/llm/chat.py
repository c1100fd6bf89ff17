"""Chat formatting with loss masks aligned to tokens by offsets.

The turns of a conversation are rendered into one text, ``<s>`` and then
``[INST]role[/INST]text</s>`` per turn. Control strings inside roles and texts are broken with
a backslash (``[\\INST]``), backslashes are doubled, so a text cannot forge a turn and reading
back restores it exactly. The whole text is encoded once with offsets; the sorted spans of the
assistant turns are intersected with the sorted token spans by binary search, which gives the
token ranges that carry loss and the characters under them. Control strings are special tokens,
so no token crosses the border of a turn.

Defined results: rows are ordered by turn, then role, then text (nulls first), repeated rows
stay repeated; a null role or text is empty, a null conversation id is one conversation; an
empty text has an empty token range; an empty table gives no rows; other columns are ignored.
A conversation is one training example and one row; its text has to fit a Spark string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsmith.llm.common import by_bytes

BOS, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
#: What a text must not contain: the template's marks and the vocabulary's own special string.
CONTROL = (BOS, HEAD, BODY, END, "<|endoftext|>")
LOSS_ROLE = "assistant"
_UNSAFE = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(HEAD) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)
#: Characters encoded in one library call (offsets take several times the text's memory).
GROUP_CHARS = 1 << 18

_MODELS: dict[str, object] = {}


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the character spans of the texts that carry loss."""
    parts, spans, at = [BOS], [], len(BOS)
    for role, text in turns:
        head, body = HEAD + escape(role) + BODY, escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, END
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def align(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """For each span: the range of tokens that overlap it, and the characters of the span that
    they cover. Both lists are sorted."""
    pairs = np.array(offsets, dtype=np.int64).reshape(-1, 2)
    starts, ends = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
    out = []
    for start, end in spans:
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(starts, end, side="left"))
        if first >= last or start == end:
            out.append((first, first, start, start))
        else:
            out.append((first, last, max(start, int(starts[first])), min(end, int(ends[last - 1]))))
    return out


def _tokenizer(path: str):
    if path not in _MODELS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([c for c in CONTROL if tokenizer.token_to_id(c) is None])
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _MODELS[path] = tokenizer
    return _MODELS[path]


_FORMATTED = "struct<formatted: string, token_ids: array<int>, loss_tokens: array<struct<first: int, last: int>>, loss_spans: array<struct<start: int, end: int>>>"


def format_turns(turns: Column, tokenizer_path: str) -> Column:
    """Format arrays of ``struct<turn, role, text>`` (in order): the text, its token ids, the
    ranges of tokens under the loss mask and the character spans that they cover."""

    @F.arrow_udf(_FORMATTED)
    def formatted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            texts, spans = [], []
            for row in batch:
                text, found = render([(t["role"] or "", t["text"] or "") for t in row.as_py() or []])
                texts.append(text)
                spans.append(found)
            at = 0
            for group in by_bytes(texts, GROUP_CHARS):
                rows = []
                for text, e in zip(group, tokenizer.encode_batch(group, add_special_tokens=False)):
                    ranges = align(spans[at], e.offsets)
                    at += 1
                    rows.append(
                        {
                            "formatted": text,
                            "token_ids": e.ids,
                            "loss_tokens": [{"first": a, "last": b} for a, b, _, _ in ranges],
                            "loss_spans": [{"start": a, "end": b} for _, _, a, b in ranges],
                        }
                    )
                yield pa.array(rows, _ARROW)

    return formatted(turns)


_ARROW = pa.struct(
    [
        ("formatted", pa.string()),
        ("token_ids", pa.list_(pa.int32())),
        ("loss_tokens", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def format_conversations(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per ``conv_id`` of (conv_id, turn, role, text): ``formatted``, ``token_ids``,
    ``loss_tokens``, ``loss_spans``."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = df.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    made = whole.select("conv_id", format_turns(F.col("turns"), tokenizer_path).alias("f"))
    return made.select("conv_id", "f.formatted", "f.token_ids", "f.loss_tokens", "f.loss_spans")


def read_back(formatted: Column, loss_spans: Column) -> Column:
    """``struct<n_turns, turns_sha256, loss_chars, loss_sha256>`` from the formatted text and
    the characters under its loss mask."""

    @F.arrow_udf("struct<n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string>")
    def read(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts, spans):
            text = text.as_py()
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in own.as_py())
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            rows.append((len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return read(formatted, loss_spans)
