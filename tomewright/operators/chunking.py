"""Splitting texts into chunks with stable identifiers, sections and pages.

Chunks are rows (document_id, chunk_index, start_offset, end_offset, text), offsets in code points. The fixed
chunker is a column expression; the greedy ones are sequential within a text and run as Arrow functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter, ids, text
from ..functions.slices import by_slices

Span = tuple[int, int]
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
_DDL = "array<struct<start:int,end:int,text:string>>"


class InvalidChunkConfig(ValueError):
    """Sizes that no chunker can work with (INVALID_CHUNK_CONFIG)."""


def _checked(size: int, overlap: int = 0) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise InvalidChunkConfig(f"size {size}, overlap {overlap}")


#: Windows that are cut out of one stretch of a text; each cut walks its stretch from the start, not the whole text.
STRETCH = 64


def fixed(c: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; the last one ends the text."""
    _checked(size, overlap)
    step, n = size - overlap, F.length(c)
    last = F.greatest(F.lit(0), n - 1 - overlap)

    def windows(at: Column) -> Column:
        def cut(stretch: Column) -> Column:
            starts = F.sequence(at, F.least(last, at + (STRETCH - 1) * step), F.lit(step))
            return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end"), F.substr(stretch, s - at + 1, F.lit(size)).alias("text")))

        # The stretch is evaluated once, as the element of an array.
        return F.get(F.transform(F.array(F.substr(c, at + 1, F.lit((STRETCH - 1) * step + size))), cut), F.lit(0))

    stretches = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(STRETCH * step))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(stretches, windows))


def token_spans(value: str, max_tokens: int) -> list[Span]:
    """Spans of at most ``max_tokens`` estimated tokens that end after a line feed where there is one, else after a space.

    All places where a span may end are found first; an end is then the last of its window, line feeds before
    spaces, and the window itself where it has neither. A text within the estimate is one span.
    """
    size = len(value)
    if round(size / text.CHARS_PER_TOKEN) <= max_tokens:
        return [(0, size)] * (size > 0)
    stops = [[m.end() for m in re.finditer(sign, value)] for sign in ("\n", " ")]
    width = int(max_tokens * text.CHARS_PER_TOKEN)

    def end_of(start: int) -> int:
        if start + width >= size:
            return size
        last = (ends[bisect_right(ends, start + width) - 1] if ends and ends[0] <= start + width else 0 for ends in stops)
        return next((end for end in last if end > start + 1), start + width)

    ends = [0]
    while ends[-1] < size:
        ends.append(end_of(ends[-1]))
    return list(pairwise(ends))


def overlapping(value: str, spans: list[Span], tokens: int) -> list[Span]:
    """``spans`` of which each but the first begins up to ``tokens`` estimated tokens earlier, at the start of a word where there is one."""
    back = int(tokens * text.CHARS_PER_TOKEN)
    out = spans[:1]
    for (before, _), (start, end) in pairwise(spans):
        low = max(before, start - back)
        word = re.compile(r"(?<!\S)\S").search(value, low, start)
        out.append((word.start() if word else low, end))
    return out


def _packed(spans: list[Span], size: int) -> list[Span]:
    """Neighbouring spans joined while they fit."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and b - out[-1][0] <= size:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pieces(value: str, pattern: re.Pattern, start: int = 0, end: int | None = None) -> list[Span]:
    """Spans between matches, each with the match that ends it."""
    end = len(value) if end is None else end
    out, at = [], start
    for m in pattern.finditer(value, start, end):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    return out + [(at, end)] * (at < end)


_LEVELS = [re.compile(p) for p in (r"\n{2,}", r"\n", r"(?<=[.!?])\s+", r" ")]


def recursive_spans(value: str, size: int, start: int = 0, end: int | None = None, level: int = 0) -> list[Span]:
    """Paragraphs, lines, sentences, words, characters: the coarsest separator whose pieces fit."""
    end = len(value) if end is None else end
    if end - start <= size:
        return [(start, end)] * (start < end)
    if level == len(_LEVELS):
        return [(a, min(a + size, end)) for a in range(start, end, size)]
    spans: list[Span] = []
    for a, b in _pieces(value, _LEVELS[level], start, end):
        spans += [(a, b)] if b - a <= size else recursive_spans(value, size, a, b, level + 1)
    return _packed(spans, size)


def paragraph_spans(value: str, size: int) -> list[Span]:
    return _packed([s for a, b in _pieces(value, _LEVELS[0]) for s in ([(a, b)] if b - a <= size else recursive_spans(value, size, a, b, 1))], size)


def sentence_spans(value: str, size: int) -> list[Span]:
    return _packed([s for a, b in _pieces(value, re.compile(r"(?<=[.!?])\s+")) for s in ([(a, b)] if b - a <= size else recursive_spans(value, size, a, b, 3))], size)


_HEADING = re.compile(r"^#{1,6}\s+.+$", re.MULTILINE)


def section_spans(value: str, size: int) -> list[Span]:
    """A chunk per heading with what follows it, split further where too long."""
    cuts = [0, *[m.start() for m in _HEADING.finditer(value)], len(value)]
    return [s for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a for s in recursive_spans(value, size, a, b)]


def adaptive_spans(value: str, size: int) -> list[Span]:
    """Sections where there are headings, paragraphs where there are empty lines, else recursive."""
    if _HEADING.search(value):
        return section_spans(value, size)
    return paragraph_spans(value, size) if "\n\n" in value else recursive_spans(value, size)


SPLITTERS: dict[str, Callable[[str, int], list[Span]]] = {
    "recursive": recursive_spans,
    "paragraph": paragraph_spans,
    "sentence": sentence_spans,
    "markdown": section_spans,
    "adaptive": adaptive_spans,
    "tokens": token_spans,
}


def register_splitter(name: str, splitter: Callable[[str, int], list[Span]]) -> None:
    SPLITTERS[name] = splitter


def _stripped(value: str, spans: list[Span]) -> list[dict]:
    out = []
    for a, b in spans:
        part = value[a:b]
        body = part.strip()
        if body:
            at = a + len(part) - len(part.lstrip())
            out.append({"start": at, "end": at + len(body), "text": body})
    return out


def greedy(name: str, size: int, overlap_tokens: int = 0) -> Callable[[Column], Column]:
    """An Arrow function that applies a registered splitter; blank chunks are dropped, others stripped.

    With an overlap each chunk also holds that many estimated tokens of the text before it.
    """
    _checked(size if name != "tokens" else int(size * text.CHARS_PER_TOKEN), int(overlap_tokens * text.CHARS_PER_TOKEN))
    splitter = SPLITTERS[name]

    def spans(value: str) -> list[Span]:
        found = splitter(value, size)
        return overlapping(value, found, overlap_tokens) if overlap_tokens else found

    return F.arrow_udf(by_slices(lambda texts: [_stripped(t, spans(t)) if t else [] for t in texts], _KIND), _DDL)


def chunks(docs: DataFrame, spans: Column, document_id: str = "document_id") -> DataFrame:
    """One row per chunk of the span array; documents without chunks leave no row."""
    return docs.select(F.col(document_id).alias("document_id"), F.posexplode(spans).alias("chunk_index", "span")).select(
        "document_id", "chunk_index", F.col("span.start").alias("start_offset"), F.col("span.end").alias("end_offset"), F.col("span.text").alias("text")
    )


def enrich(chunked: DataFrame, texts: DataFrame, strategy: str, chars_per_page: int = 3000) -> DataFrame:
    """Counts, checksum, identifier, page, section and totals. ``texts``: (document_id, headings)."""
    per_document = Window.partitionBy("document_id")
    return chunked.join(texts.select("document_id", "headings"), "document_id", "left").select(
        ids.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"),
        "document_id",
        "chunk_index",
        "text",
        "start_offset",
        "end_offset",
        text.count_tokens(F.col("text")).alias("token_count"),
        F.length("text").alias("character_count"),
        frontmatter.section_at(F.col("headings"), F.col("start_offset")).alias("section_title"),
        frontmatter.page_number(F.col("start_offset"), chars_per_page).alias("page_number"),
        ids.sha256_hex(F.col("text")).alias("checksum"),
        F.count(F.lit(1)).over(per_document).alias("total_chunks"),
        F.lit(strategy).alias("strategy"),
    )


def document_totals(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.sum("token_count").alias("total_tokens"))


def sections_as_of(chunked: DataFrame, heads: DataFrame) -> DataFrame:
    """Chunks (document_id, start_offset) with the title of the last heading (document_id, pos, title) at or before them.

    One shuffle by document: both sides stand in one order, and the last title is carried forward.
    """
    left = chunked.select("document_id", F.col("start_offset").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title"))
    right = heads.select("document_id", "pos", F.lit(0).alias("kind"), "title")
    order = Window.partitionBy("document_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("section_title", F.last("title", ignorenulls=True).over(order)).where("kind = 1").select("document_id", F.col("pos").alias("start_offset"), "section_title")
