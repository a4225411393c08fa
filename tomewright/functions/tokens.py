"""Real tokens of a public vocabulary, where its file is at hand; else the estimate by characters."""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


@lru_cache(maxsize=4)
def tokenizer(path: str | None):
    """The vocabulary's encoder, or None where there is no such file or it cannot be read."""
    if not path or not os.path.isfile(path):
        return None
    try:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)
    except Exception:  # noqa: BLE001 - the library raises bare exceptions for damaged files
        return None


def backend(path: str | None) -> str:
    return "bpe" if tokenizer(path) is not None else "estimate"


def count_tokens(c: Column, path: str | None = None) -> Column:
    """Tokens of a text: by the vocabulary at ``path``, on executors that have it, else estimated."""
    if tokenizer(path) is None:
        return text.count_tokens(c)

    @F.arrow_udf("int")
    def run(values: pa.Array) -> pa.Array:
        made = tokenizer(path).encode_batch([v or "" for v in values.to_pylist()], add_special_tokens=False)
        return pa.array([None if v is None else len(e.ids) for v, e in zip(values.to_pylist(), made, strict=True)], pa.int32())

    return run(c)


def token_spans(value: str, path: str, size: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of windows of ``size`` real tokens of which neighbours share ``overlap``; the last one ends the text.

    Characters between tokens belong to the window before; a character whose bytes are several tokens is never cut.
    """
    offsets = tokenizer(path).encode(value, add_special_tokens=False).offsets
    out = []
    at = 0
    while at < len(offsets):
        end = min(at + size, len(offsets))
        # The next window's first character is this one's end; a token that shares it with the one before stays with that.
        while end < len(offsets) and end > at + 1 and offsets[end][0] < offsets[end - 1][1]:
            end -= 1
        out.append((offsets[at][0] if out else 0, offsets[end][0] if end < len(offsets) else len(value), end - at))
        if end == len(offsets):
            break
        start = max(end - overlap, at + 1)
        while start > at + 1 and offsets[start][0] < offsets[start - 1][1]:
            start -= 1
        at = start
    return out


def windows(path: str, size: int, overlap: int = 0):
    """A function of a text column that gives its windows as (start, end, text, tokens)."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("INVALID_CHUNK_CONFIG: sizes are positive and above the overlap")
    if tokenizer(path) is None:
        raise ValueError(f"INVALID_CHUNK_CONFIG: no vocabulary at {path}")

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("tokens", pa.int32())]))

    @F.arrow_udf("array<struct<start: int, end: int, text: string, tokens: int>>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "text": v[a:b], "tokens": n} for a, b, n in token_spans(v, path, size, overlap)] if v else [] for v in values.to_pylist()], kind)

    return run
