"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word shingles (a shorter text is one
shingle, a blank one has none). Sketches of parts merge into the sketch of the whole; two of them estimate
resemblance (Jaccard), containment and the distinct shingle count. Up to k shingles the estimates are exact.

Defined results: null text is the empty text; two texts without shingles resemble fully, one with and one
without not at all; rows repeating an id follow each other by text; null ids come after all others; an empty
table gives an empty result; texts are read whole at any length; rows that tie in id and text are equal, in either order;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, slices, text_rank

K = 256
WIDTH = 5
#: Bytes of the texts of about two ranges.
RANGE_BYTES = 64 << 20
_EMPTY = np.zeros(0, np.uint64)


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    if not words:
        return _EMPTY
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    h = xxhash.xxh3_64_intdigest
    return np.array([h(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, in order."""
    if len(hashes) > 4 * k:
        # Repeats may crowd the smallest, so the cut is tried before it is relied on.
        some = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    return bottom(shingle_hashes((text or "").encode("utf-8", "surrogatepass").split(), width), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common hashes among the k smallest of the union."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= union[-1]) / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Exact below k hashes, else (k - 1) over the k-th smallest as a part of the hash range."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, from resemblance and the counts."""
    if not len(a):
        return 1.0
    union = merge(a, b, k)
    common = resemblance(a, b, k) * distinct_count(union, k)
    return min(1.0, common / distinct_count(a, k))


def to_hex(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def sketch_documents(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (hex) and estimated distinct shingles of every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("distinct_shingles", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, "doc_id", "text"):
            found = [sketch(t, k, width) for t in texts]
            yield frame(schema, ids, [to_hex(s) for s in found], [distinct_count(s, k) for s in found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


def merge_sketches(parts: DataFrame, by: str, k: int = K) -> DataFrame:
    """One sketch per value of ``by`` from rows (by, fingerprint): parts of a task merge before the shuffle."""
    schema = pa.schema([("key", pa.string()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for keys, prints in slices(batches, "key", "fingerprint"):
            for key, p in zip(keys, prints, strict=True):
                held[key] = merge(held.get(key, _EMPTY), from_hex(p), k)
            if len(held) > 5000:
                yield frame(schema, list(held), [to_hex(v) for v in held.values()])
                held = {}
        yield frame(schema, list(held), [to_hex(v) for v in held.values()])

    rows = parts.select(F.col(by).cast("string").alias("key"), "fingerprint").mapInArrow(run, "key string, fingerprint string")
    merged = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key string, fingerprint string")
    return merged.withColumnRenamed("key", by)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, role) dealt to ranges of descending ids, each ordered, with the head of the range after it.

    Range bounds come from a quantile sketch of the ids; the driver holds a bound and a head per range. Only a
    head (the rows of one id) is sent twice: role 0 is a row in its place, 1 one that ends the range before,
    2 the first of all, which ends the last range.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Ranges follow the bytes of the texts, so that no task grows with the corpus.
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(text_rank(docs.sparkSession), -(-size // RANGE_BYTES))
    bounds = np.array(sorted(set(own.approxQuantile("doc_id", [i / (2 * parts) for i in range(1, 2 * parts)], 0.1 / parts))), np.int64)
    lowest = np.iinfo(np.int64).min

    def of(ids: pa.Array) -> np.ndarray:
        # Range 0 holds the largest ids; null ids fall into the last one.
        return len(bounds) - np.searchsorted(bounds, ids.fill_null(lowest).to_numpy(zero_copy_only=False), side="right")

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(of(ids), pa.int32())

    heads = {r["bucket"]: r["head"] for r in own.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    to = {heads[b]: (order[i - 1], 1 if i else 2) for i, b in enumerate(order)}

    @F.arrow_udf("array<struct<bucket:int,role:int>>")
    def routes(ids: pa.Array) -> pa.Array:
        out = []
        for doc, b in zip(ids.to_pylist(), of(ids).tolist(), strict=True):
            place = [{"bucket": b, "role": 0}]
            if doc in to:
                place.append({"bucket": to[doc][0], "role": to[doc][1]})
            out.append(place)
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("role", pa.int32())])))

    dealt = own.select("doc_id", "text", F.inline(routes("doc_id")))
    return dealt.repartition(2 * parts, "bucket").sortWithinPartitions("bucket", "role", F.desc_nulls_last("doc_id"), "text")


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_edited(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, and their resemblances."""
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double"
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[(c, pa.float64()) for c in ("near_edited", "near_next", "distinct_shingles")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: bucket, id, text, sketch
        for buckets, roles, ids, texts in slices(batches, "bucket", "role", "doc_id", "text"):
            out: tuple[list, ...] = tuple([] for _ in schema)
            for b, role, doc, text in zip(buckets, roles, ids, texts, strict=True):
                own = sketch(text, k, width)
                if held is not None and held[0] == b:
                    _, before, old, old_sketch = held
                    made = edited(old, text)
                    made_sketch = sketch(made, k, width)
                    row = (before, len(old), hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(old_sketch), to_hex(made_sketch), resemblance(old_sketch, made_sketch, k), resemblance(old_sketch, own, k), distinct_count(old_sketch, k))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                # Of the rows that end a bucket only the first is anyone's next.
                held = None if role else (b, doc, text, own)
            yield frame(schema, *out)

    return with_next(docs).mapInArrow(run, ddl)
