"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight bytes. Two that differ in at most three bits agree in at least five byte
positions. The index maps (positions, their bytes) to fingerprints, for a family of position subsets such that
any five positions contain one of them; per pair of a posting the shared positional bytes are tallied, pairs that
reach five are kept and verified. The subsets grow from three to five positions with the number of distinct
fingerprints, so that a posting stays short at any size; each family finds the same pairs.

``near_duplicates`` links SimHash fingerprints by their Hamming distance. ``similar_documents`` links texts by
the resemblance of their five-word shingles: at 0.8 a SimHash differs in about ten bits, which no byte survives
for sure, so there each byte is the hash of one shingle, the least under its own order, and agrees with
probability equal to the resemblance. The same index and tally find the candidates (at a resemblance of 0.8
94 in 100, at 0.9 99), and whole shingle sets verify them, exactly: rows that reach the tally with another one are given
their sets in the unit where they first do, and a matrix product gives all intersections of a unit.

What is equal meets first (an aggregate), so copies cost one row. Long postings are dealt to tasks as pairs of
parts, and a posting yields the links of a spanning forest in place of all pairs: nothing connected is lost.
Components come from ``components.connected_components``.

Defined results: null and blank texts have fingerprint zero and link like any other, and are copies of each other;
a document of fewer words than a shingle has one shingle, the whole sequence; rows repeating an id are one
document each and share the component; a null id is linked as any other, and is never the smallest id unless its
component has no other (then null); an empty table gives an empty result; of other columns only ``keep_one``
takes notice, and keeps them, whatever their names. Texts are read whole at any length; a bit that half of the shingles
have ties, and is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stretches, frame, fresh, materialize, mixed, only_marked, slices
from .components import connected_components
from .postings import by_unit, read_units, spans, units

DISTANCE = 3
#: Byte positions in which linked fingerprints agree at least.
MATCHES = 8 - DISTANCE
#: Rows of a posting, or of each of two parts of a longer one, that are compared in one task.
BLOCK = 1024
RESEMBLANCE = 0.8
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_SALTS = np.random.default_rng(88).integers(0, 2**64, 8, np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    n = len(words) - width + 1
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, 1 << 14):
        some = np.array([h(joined[a:b], 42) for a, b in zip(first[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=True)], ">u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, "doc_id", "text"):
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield frame(schema, ids, fps)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def position_family(n: int) -> list[tuple[int, ...]]:
    """Subsets of the eight byte positions of which any five positions contain at least one.

    Three positions: five matches put three in one half. Four: with a half matched in full, that half; else
    three and two, where three of a half contain one of its two disjoint pairs. Five: all subsets.
    """
    left, right = (0, 1, 2, 3), (4, 5, 6, 7)
    if n < 1 << 24:
        return [*combinations(left, 3), *combinations(right, 3)]
    if n < 1 << 32:
        mixed_ = {a + b for a in ((0, 1), (2, 3)) for b in combinations(right, 2)} | {a + b for a in combinations(left, 2) for b in ((4, 5), (6, 7))}
        return [left, right, *sorted(mixed_)]
    return list(combinations(range(8), 5))


def index(distinct: DataFrame, node: str, n: int) -> DataFrame:
    """The units of work (family, bytes, left, right) of rows (node, fp), for about ``n`` rows."""
    masks = [sum(0xFF << (8 * (7 - p)) for p in s) for s in position_family(n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = F.array(*[F.struct(F.lit(i).cast("int").alias("family"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)])
    return units(distinct.select(*distinct.columns, F.inline(entries)), ["family", "bytes"], node, BLOCK)


def tallies(fps: np.ndarray) -> np.ndarray:
    """Per pair, the byte positions in which both agree: each position's list of bytes is gone through once."""
    lanes = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(fps), len(fps)), np.uint8)
    for k in range(8):
        out += lanes[:, k, None] == lanes[None, :, k]
    return out


def forest(fps: np.ndarray, parts: np.ndarray, verified) -> list[tuple[int, int]]:
    """Places of the links of a spanning forest: pairs that reach the tally and that ``verified(i, places)`` confirms.

    Rows of one part meet only where all are of one.
    """
    cross = len(np.unique(parts)) > 1
    tally = tallies(fps) >= MATCHES
    comp = np.arange(len(fps))
    out = []
    # Rows that many others are close to come first and join most of them.
    for i in np.argsort(-tally.sum(axis=1), kind="stable").tolist():
        open_ = tally[i] & (comp != comp[i])
        if cross:
            open_ &= parts != parts[i]
        for j in verified(i, np.flatnonzero(open_)):
            if comp[i] != comp[j]:
                comp[comp == comp[j]] = comp[i]
                out.append((i, j))
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to connect all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, upto in read_units(batches, ["family", "bytes"]):
            every, parts = table.column("fp").to_numpy().view(np.uint64), table.column("part").to_numpy()
            found = []
            for start, stop in spans(upto):
                fps = every[start:stop]
                found += [(start + i, start + j) for i, j in forest(fps, parts[start:stop], lambda i, at, fps=fps: at[np.bitwise_count(fps[at] ^ fps[i]) <= DISTANCE].tolist())]
            if found:
                a, b = np.array(found).T
                yield frame(LINKS, every[a].view(np.int64), every[b].view(np.int64))

    return by_unit(index(distinct, "fp", n), ["family", "bytes"]).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component) per row of ``docs``, component being the smallest id of what is connected to it."""
    own = materialize(fingerprints(docs, width))
    groups = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(groups.select("fp"), groups.count())
    joined = connected_components(edges)
    labelled = groups.join(joined, groups["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component"))
    return own.join(labelled.join(named, "root").select("fp", "component"), "fp").select("doc_id", "fp", "component")


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, digests): the shingle hashes of all texts in order, how many each has, and a hash of its words."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(~_SPACE[data], prepend=False))
    begin, end = edges[::2], edges[1::2]
    words = mixed(Stretches(data).of(begin, end))
    stops = np.cumsum([len(r) + 1 for r in raws])
    upto = np.searchsorted(begin, stops)
    n = np.diff(upto, prepend=0)
    sums = Stretches(words)
    digests = mixed(sums.of(upto - n, upto) + n.astype(np.uint64))
    counts = np.where(n > width, n - width + 1, np.minimum(n, 1))
    first = np.repeat(upto - n, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(sums.of(first, np.minimum(first + width, np.repeat(upto, counts)))), counts, digests


def first_families(fps: np.ndarray, family: int, n: int) -> np.ndarray:
    """Which two fingerprints of a posting agree in all positions of no earlier family than this one."""
    out = np.ones((len(fps), len(fps)), bool)
    for subset in position_family(n)[:family]:
        own = fps & np.uint64(sum(0xFF << (8 * (7 - p)) for p in subset))
        out &= own[:, None] != own[None, :]
    return out


PLACE_DDL = "node long, family int, bytes long, part int, left int, right int"


def tallied(met: DataFrame, n: int) -> DataFrame:
    """Rows of units, with their unit, that reach the tally with another row, each pair in its first posting."""
    schema = pa.schema([("node", pa.int64()), ("family", pa.int32()), ("bytes", pa.int64()), ("part", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, upto in read_units(batches, ["family", "bytes"]):
            every, parts, families = table.column("fp").to_numpy().view(np.uint64), table.column("part").to_numpy(), table.column("family").to_numpy()
            keep = np.zeros(len(every), bool)
            for start, stop in spans(upto):
                fps, own = every[start:stop], parts[start:stop]
                fit = tallies(fps) >= MATCHES
                np.fill_diagonal(fit, False)
                if own.min() < own.max():
                    fit &= own[:, None] != own[None, :]
                if fit.any():
                    fit &= first_families(fps, int(families[start]), n)
                keep[start:stop] = fit.any(axis=1)
            if keep.any():
                for batch in table.select(schema.names).filter(pa.array(keep)).cast(schema).to_batches():
                    yield frame(schema, *batch.columns)

    return by_unit(met, ["family", "bytes"]).mapInArrow(run, PLACE_DDL)


def resembling(rows: DataFrame, texts: DataFrame, groups: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): links of units of ``tallied`` by whole shingle sets, enough to connect all that a unit links."""
    from .minhash import forest as spanning
    from .minhash import intersections, whole_sets

    whole = rows.join(whole_sets(rows.select("node").distinct(), texts, groups, width), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, upto in read_units(batches, ["family", "bytes"], 500):
            nodes, parts = table.column("node").to_numpy(), table.column("part").to_numpy()
            made = table.column("set").to_pylist()
            found = []
            for start, stop in spans(upto):
                sets, own = [np.frombuffer(s, np.uint64) for s in made[start:stop]], parts[start:stop]
                n = np.array([len(s) for s in sets])
                met = intersections(sets)
                links = met >= least * (n[:, None] + n[None, :] - met) - 1e-9
                if own.min() < own.max():
                    links &= own[:, None] != own[None, :]
                found += [(start + i, start + j) for i, j in spanning(links)]
            if found:
                a, b = nodes[np.array(found).T]
                yield frame(LINKS, a, b)

    return by_unit(whole, ["family", "bytes"]).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def similar_documents(docs: DataFrame, width: int = 5, least: float = RESEMBLANCE) -> DataFrame:
    """(doc_id, row, root) per row of ``docs``, ``row`` being a hash of its text: rows have one root that a chain of resemblances of ``least`` connects.

    Texts that differ in blanks and case (A-Z) only are copies.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())])
        for ids, texts, rows in slices(batches, "doc_id", "text", "row"):
            hashes, counts, digests = shingles(texts, width)
            some = counts > 0
            lanes = np.zeros((len(texts), 8), np.uint8)
            if some.any():
                starts = (np.cumsum(counts) - counts)[some]
                for k, salt in enumerate(_SALTS):
                    lanes[some, k] = (np.minimum.reduceat(mixed(hashes ^ salt), starts) & np.uint64(0xFF)).astype(np.uint8)
            yield frame(schema, ids, rows, digests.view(np.int64), lanes.view(np.int64).ravel())

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    own = materialize(text.mapInArrow(prints, "doc_id long, row long, digest long, fp long"))
    n = own.count()
    groups = materialize(own.groupBy("digest").agg(F.min("fp").alias("fp"), F.min("row").alias("row")).withColumnRenamed("digest", "node"))
    left = materialize(tallied(index(groups.select("node", "fp"), "node", n), n))
    joined = connected_components(resembling(left, text.select("row", "text"), groups, width, least))
    return own.join(joined, own["digest"] == joined["node"], "left").select("doc_id", "row", F.coalesce("component", "digest").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, least: float = RESEMBLANCE) -> DataFrame:
    """One row of ``docs`` per group of ``similar_documents``: that of the smallest id (none last), then of the least text hash.

    Rows that agree in id and text are one. Rows that repeat an id with other texts are told apart.
    """
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("x")
    doc, row = fresh(docs, "doc", "row")
    keep = materialize(similar_documents(docs.select("doc_id", "text"), width, least).groupBy("root").agg(chosen).select(F.col("x.doc_id").alias(doc), F.col("x.row").alias(row)))
    marked = only_marked(docs.withColumn(row, F.xxhash64("text")), keep, row)
    met = marked.join(keep, (marked[row] == keep[row]) & F.col("doc_id").cast("long").eqNullSafe(keep[doc]), "left_semi")
    return met.dropDuplicates(["doc_id", row]).select(*[F.col(f"`{c}`") for c in docs.columns])
