"""Exact substring deduplication with a sparse suffix array, range-partitioned by leading tokens.

Every string of ``length`` bytes that occurs at two or more starts anywhere has all its bytes removed, at each
of its occurrences. A suffix array of all bytes would be many times the corpus, so suffixes are taken at
anchors: the anchor of a string is the place of its least 32-byte token (by hash, leftmost), hence equal
strings have their anchor at the same distance from their start. A text has about one anchor in 185 bytes.

1. Anchors are grouped by the hash of their token. One whose token occurs once has no repeated string. Where
   the whole stretch of strings around an anchor occurs twice, all of them are repeated: nothing is compared.
2. The others become suffixes with the stretch around them. Sampled splitters range-partition them by their
   leading token (equal ones share a bucket, so no boundary parts equal suffixes). Within a bucket, the strings
   of an anchor group are sorted by their distance to the anchor and then by tokens of 80 bytes, by multikey
   quicksort: each round orders what is still tied by the next token and sets aside what stands alone. What is
   tied at the end is repeated. Long groups are sorted by ranges of distances, so memory follows the number of
   suffixes and not of strings.

Tokens are compared by 64-bit polynomial fingerprints.

Beside the bytes, ``shared_passages`` tells which words stand in passages of ``WORDS`` words or more that another
document has too, many of which are shorter than ``length`` bytes. It takes anchors of word strings in the same way;
those whose leading words occur once go first, by a bit map of fixed size; the others are compared by hashes of
the strings around them, at steps of ``STEP`` words, so that a passage of ``WORDS - STEP`` words may count and none of
``WORDS`` is lost.

Defined results: null text is the empty text; texts
below ``length`` bytes lose nothing; rows agreeing in id and text repeat each other like any others; an empty
table gives an empty result; texts are read whole at any length; strings that tie in the order are equal and all go,
the first as well; further columns are ignored by the digest and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stretches, bit_map, frame, is_marked, materialize, mixed, slices

LENGTH = 400
#: Bytes of an anchor's leading token, and of the tokens that a round of sorting compares.
LEAD, TOKEN = 32, 80
CHUNK = 1 << 19
#: Strings that are sorted at once.
STRINGS = 1 << 20
#: Words of a passage, of an anchor's leading words, and between the strings that are compared around it.
WORDS, LEAD_WORDS, STEP = 50, 4, 6

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, low, high, token, stretch): anchors of the strings that start at low..high, with fingerprints."""
    data = np.frombuffer(raw, np.uint8)
    parts = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        some = Stretches(data[at : at + CHUNK + length - 1])
        tokens = mixed(some.all(LEAD))
        places = np.arange(len(tokens), dtype=np.uint64)
        least = _sliding_min(tokens >> np.uint64(20) << np.uint64(20) | places, length - LEAD + 1)
        anchor = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        low = np.concatenate(([0], np.nonzero(np.diff(anchor))[0] + 1))
        high = np.concatenate((low[1:] - 1, [len(anchor) - 1]))
        anchor = anchor[low]
        shape = ((high - low).astype(np.uint64) << np.uint64(32)) | (anchor - low).astype(np.uint64)
        stretch = mixed(some.of(low, high + length) ^ mixed(shape))
        parts.append((anchor + at, low + at, high + at, tokens[anchor], stretch))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


ANCHOR = pa.schema([(c, pa.int64()) for c in ("digest", "anchor", "low", "high", "token", "stretch")])
SUFFIX = pa.schema([("lead", pa.binary()), ("digest", pa.int64()), ("low", pa.int64()), ("ahead", pa.int64()), ("compared", pa.bool_()), ("stretch", pa.binary())])
RANGE = pa.schema([(c, pa.int64()) for c in ("digest", "start", "stop")])


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, texts in slices(batches, "digest", "text"):
            rows, found = [], []
            for digest, text in zip(digests, texts, strict=True):
                own = anchors(text.encode("utf-8", "surrogatepass"), length)
                if len(own[0]):
                    rows.append(np.full(len(own[0]), digest, np.int64))
                    found.append(own)
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield frame(ANCHOR, np.concatenate(rows), *columns[:3], columns[3].view(np.int64), columns[4].view(np.int64))

    return docs.mapInArrow(run, _ddl(ANCHOR))


def classified(table: DataFrame) -> DataFrame:
    """(digest, anchor, low, high, kind) of anchors whose token occurs at least twice.

    Kind 0: all strings of the anchor are repeated; 1: to be compared; 2: stands for those of kind 0 in comparisons.

    Equal stretches are counted before any shuffle by token, so that a token that very many copies share costs
    a row; copies meet their count again in a join by (token, stretch) that splits where it is skewed.
    """
    place = F.struct("digest", "anchor", "low", "high")
    stretches = table.groupBy("token", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    tokens = stretches.groupBy("token").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    shared = materialize(stretches.join(tokens, "token").select("token", "stretch", "n", "kinds", "place"))
    alone = shared.where("n = 1").select("place.*", F.lit(1).cast("long").alias("kind"))
    standing = shared.where("n > 1 AND kinds > 1").select("place.*", F.lit(2).cast("long").alias("kind"))
    twice = shared.where("n > 1").select("token", "stretch")
    whole = table.join(twice, ["token", "stretch"]).select("digest", "anchor", "low", "high", F.lit(0).cast("long").alias("kind"))
    return alone.unionByName(standing).unionByName(whole)


def suffixes(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    wanted = places.where("kind > 0").groupBy("digest").agg(F.collect_list(F.struct("anchor", "low", "high", "kind")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, texts, asked in slices(batches, "digest", "text", "wanted", step=50):
            out: tuple[list, ...] = tuple([] for _ in SUFFIX)
            for digest, text, some in zip(digests, texts, asked, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in some:
                    a, low, high = x["anchor"], x["low"], x["high"]
                    for column, value in zip(out, (raw[a : a + LEAD], digest, low, a - low, x["kind"] == 1, raw[low : high + length]), strict=True):
                        column.append(value)
            yield frame(SUFFIX, *out)

    # Rows that agree in id and text have equal stretches, so only one of them is ever asked for.
    return docs.join(wanted, "digest").select("digest", "text", "wanted").mapInArrow(run, _ddl(SUFFIX))


def _tied(first: np.ndarray, starts: np.ndarray, prints: Stretches, length: int) -> np.ndarray:
    """Which strings equal another one of the same ``first`` key: multikey quicksort over their tokens."""
    out = np.zeros(len(first), bool)
    at = np.arange(len(first))
    order = np.argsort(first, kind="stable")
    at, rank = at[order], first[order]
    depth = 0
    while len(at):
        cut = np.concatenate(([True], rank[1:] != rank[:-1]))
        alone = cut & np.concatenate((cut[1:], [True]))
        group = np.cumsum(cut)
        at, group = at[~alone], group[~alone]
        if depth == length or not len(at):
            break
        upto = min(length, depth + TOKEN)
        token = prints.of(starts[at] + depth, starts[at] + upto)
        order = np.lexsort((token, group))
        at, group, token = at[order], group[order], token[order]
        rank = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]) | (token[1:] != token[:-1]))))
        depth = upto
    out[at] = True
    return out


def repeated_ranges(bucketed: DataFrame, length: int) -> DataFrame:
    """(digest, start, stop): bytes of the strings that equal another string of their anchor group."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: (group, digest, low, ahead, compared, stretch) of whole groups."""
        raw = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        prints = Stretches(raw)
        sizes = np.array([len(r[5]) for r in rows])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        strings = sizes - length + 1
        ahead = np.array([r[3] for r in rows])
        group = np.array([r[0] for r in rows])
        low = np.array([r[2] for r in rows])
        digest = np.array([r[1] for r in rows])
        compared = np.array([r[4] for r in rows])
        span = length - LEAD + 1
        step = max(1, STRINGS // max(1, len(rows)))
        hit_row, hit_at = [], []
        for d in range(0, span, step):
            # Strings whose distance to the anchor lies in d .. d + step - 1.
            first = np.maximum(0, ahead - (d + step - 1))
            last = np.minimum(strings - 1, ahead - d)
            many = np.maximum(0, last - first + 1)
            if not many.any():
                continue
            row = np.repeat(np.arange(len(rows)), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            tied = _tied(group[row] * 1024 + (ahead[row] - at), begin[row] + at, prints, length) & compared[row]
            hit_row.append(row[tied])
            hit_at.append(at[tied])
        row, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hit_row, hit_at))
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        cut = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))) if len(row) else np.zeros(0, bool)
        opens = np.nonzero(cut)[0]
        closes = np.concatenate((opens[1:] - 1, [len(row) - 1])) if len(opens) else opens
        return frame(RANGE, digest[row[opens]], low[row[opens]] + at[opens], low[row[closes]] + at[closes] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # groups that are whole
        own: list[tuple] = []  # the group that may go on
        lead, number, held = None, 0, 0
        for columns in slices(batches, *SUFFIX.names, step=2000):
            for this, digest, low, ahead, compared, stretch in zip(*columns, strict=True):
                if this != lead:
                    if len(own) > 1 and any(r[4] for r in own):
                        done += own
                    else:
                        held -= sum(len(r[5]) for r in own)
                    own, lead, number = [], this, number + 1
                    if held > STRINGS:
                        yield solve(done)
                        done, held = [], 0
                own.append((number, digest, low, ahead, compared, stretch))
                held += len(stretch)
        if len(own) > 1:
            done += own
        if done:
            yield solve(done)

    return bucketed.mapInArrow(run, _ddl(RANGE))


_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(~_BLANK[data], prepend=False))
    return mixed(Stretches(data).of(edges[::2], edges[1::2]))


def word_anchors(hashes: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(place, token) of the anchors of all strings of ``words`` words: the least of their runs of ``LEAD_WORDS``."""
    if len(hashes) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = mixed(Stretches(hashes).all(LEAD_WORDS))
    width = words - LEAD_WORDS + 1
    least = _sliding_min(tokens, width)
    chosen = np.zeros(len(tokens), bool)
    for k in range(width):
        chosen[k : k + len(least)] |= tokens[k : k + len(least)] == least
    at = np.flatnonzero(chosen)
    return at, tokens[at].view(np.int64)


def shared_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(digest, starts): first words of strings of ``words - STEP`` words that another digest of ``docs`` (digest, text) has too."""
    size = words - STEP

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.int64())])
        for (texts,) in slices(batches, "text"):
            yield frame(schema, np.concatenate([word_anchors(word_hashes(t.encode("utf-8", "surrogatepass")), words)[1] for t in texts]))

    tokens = docs.select("text").mapInArrow(first, "token long")
    twice = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shipped = docs.sparkSession.sparkContext.broadcast(bit_map(twice, "token", 26))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.int64()), ("start", pa.int32()), ("string", pa.int64())])
        for digests, texts in slices(batches, "digest", "text"):
            rows, starts, strings = [], [], []
            for digest, text in zip(digests, texts, strict=True):
                hashes = word_hashes(text.encode("utf-8", "surrogatepass"))
                at, token = word_anchors(hashes, words)
                at = at[is_marked(shipped.value, token)]
                begin = np.unique((at[:, None] - np.arange(0, words - LEAD_WORDS, STEP)).ravel())
                begin = begin[(begin >= 0) & (begin + size <= len(hashes))]
                if len(begin):
                    rows.append(np.full(len(begin), digest, np.int64))
                    starts.append(begin)
                    strings.append(mixed(Stretches(hashes).of(begin, begin + size)).view(np.int64))
            if rows:
                yield frame(schema, np.concatenate(rows), np.concatenate(starts).astype(np.int32), np.concatenate(strings))

    strings = materialize(docs.select("digest", "text").mapInArrow(second, "digest long, start int, string long"))
    # Written, so that the join reads two shuffles and may split a string that very many copies have.
    common = materialize(strings.groupBy("string").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("string"))
    return strings.join(common, "string").groupBy("digest").agg(F.collect_set("start").alias("starts"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(digest, ranges) of removed bytes per digest of ``docs`` (digest, text without nulls)."""
    places = materialize(classified(materialize(anchor_table(docs, length))))
    bucketed = suffixes(docs, places, length)
    bucketed = materialize(bucketed).repartitionByRange("lead").sortWithinPartitions("lead")
    compared = repeated_ranges(bucketed, length)
    whole = places.where("kind = 0").select("digest", F.col("low").alias("start"), (F.col("high") + length).alias("stop"))
    return compared.unionByName(whole).groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def _merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and shared_words of every row of ``docs``; the last counts words in shared passages."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.select(F.xxhash64("doc_id", "text").alias("digest"), "doc_id", "text")
    found = repeats(own.select("digest", "text"), length)
    passages = shared_passages(own.select("digest", "text"))
    # One table of what was found, so that texts meet it in one join.
    both = materialize(found.join(passages, "digest", "full").select("digest", "ranges", "starts"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("shared_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, ranges, starts in slices(batches, "doc_id", "text", "ranges", "starts"):
            out: tuple[list, ...] = tuple([] for _ in schema)
            for doc, text, some, at in zip(ids, texts, ranges, starts, strict=True):
                raw, spans = text.encode("utf-8", "surrogatepass"), _merged(some)
                kept = _cut(raw, spans)
                shared = sum(b - a for a, b in _merged([{"start": x, "stop": x + WORDS - STEP} for x in at or ()]))
                for column, value in zip(out, (doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), shared), strict=True):
                    column.append(value)
            yield frame(schema, *out)

    return own.join(both, "digest", "left").select("doc_id", "text", "ranges", "starts").mapInArrow(run, _ddl(schema))
