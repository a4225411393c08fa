"""Ranked lexical search by impact-ordered, score-at-a-time evaluation.

The contribution of a term to a document's score, its impact, is known once the corpus is counted. So documents are
first reduced to the query terms they hold, in a written table that also gives the counts; then each task takes blocks
of that table, groups a block's postings by term and exact impact, and goes through the groups of an item in
descending order of impact, adding them to one accumulator per document. What a term can still add to any document is
the impact of its next group. Evaluation stops only when the sum of these bounds proves that none but a few documents
can be among the best ``k``, and the scores of those few are then completed from the documents' own terms; else it
goes on to the last group, where all scores are complete anyway. The best of earlier blocks of a task raise the bar for
later ones. A task sends on at most ``k`` rows per item, so no table of items by documents is ever shuffled.

Items are a stated set; ITEM_BLOCK of them go to the tasks of a scan at once, and their terms with the counts are all
that the driver ever holds.

Defined results: a null or blank text has no term, in documents (which then count for nothing) and in items (which then
have no rows); rows that repeat an item_id are one item with the terms of all; rows that repeat a doc_id are documents
of their own and may both be ranked; equal scores go by ascending doc_id, null last; documents with a score of 0 are
left out; texts are read whole at any length; an empty table gives an empty result; of other columns no notice is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, frame, materialize, slices

#: Items whose terms go to the tasks of one scan.
ITEM_BLOCK = 1024
#: Documents whose postings are grouped at once.
BLOCK = 8192
#: Groups of impact are gone through in so many steps at most, with a look at the bounds after each.
STEPS = 12
#: Documents per wanted one that may be completed in place of going on.
COMPLETED = 8

_TERM = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Longest runs of letters and digits, where all beyond ASCII counts as a letter, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return 10 + (90 * lengths * n) // total


def saturation(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norms)


FORWARD = "doc_id long, n long, terms array<int>, tf array<long>"


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per document that has a term: all its terms counted (n), and those of the vocabulary with their occurrences."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shipped.value.get
        for ids, texts in slices(batches, "doc_id", "text"):
            kept, lengths, terms, tfs = [], [], [], []
            for i, t in zip(ids, texts, strict=True):
                own = terms_of(t)
                if own:
                    found = Counter(map(place, own))
                    found.pop(None, None)
                    kept.append(i)
                    lengths.append(len(own))
                    terms.append(list(found))
                    tfs.append(list(found.values()))
            yield frame(schema, kept, lengths, terms, tfs)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FORWARD)


class Postings:
    """One block of documents: postings grouped by term and exact impact, impacts descending, and the same by document."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.starts, self.terms, self.impacts = starts, terms, impacts
        docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((-impacts, terms))
        self.docs, self.descending = docs[order], impacts[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.n_docs = len(starts) - 1

    def completed(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, from their own terms; ``wanted`` marks an item's terms."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        at = np.repeat(self.starts[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, np.repeat(np.arange(len(docs)), sizes), np.where(wanted[self.terms[at]], self.impacts[at], 0))
        return scores

    def best(self, item: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, whole scores, postings gone through): all that can be among the best ``k`` of this block with a score of ``bar`` or more."""
        at, stop = self.bounds[item], self.bounds[item + 1]
        at, stop = at[at < stop], stop[at < stop]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        scores = np.zeros(self.n_docs, np.int64)
        first, n_seen = at.copy(), 0
        tops = self.descending[at]
        if int(tops.sum()) < bar:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        # Steps end between groups: each takes all groups of at least an impact, which falls to zero.
        for step in range(1, STEPS + 1):
            least = int(tops.max()) * (STEPS - step) // STEPS
            for j in range(len(at)):
                begin = at[j]
                if begin < stop[j] and self.descending[begin] >= least:
                    end = begin + int(np.searchsorted(-self.descending[begin : stop[j]], -least, side="right"))
                    # A document has a term once, so no place is met twice in a term's groups.
                    scores[self.docs[begin:end]] += self.descending[begin:end]
                    at[j] = end
            n_seen = int((at - first).sum())
            open_ = at < stop
            rest = int(self.descending[at[open_]].sum())
            kth = int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0
            floor = max(kth, bar)
            if rest == 0:
                found = np.flatnonzero(scores >= max(floor, 1))
                return found, scores[found], n_seen
            if rest < floor:
                found = np.flatnonzero(scores + rest >= floor)
                if len(found) <= COMPLETED * k:
                    wanted = np.zeros(len(self.bounds) - 1, bool)
                    wanted[item] = True
                    return found, self.completed(found, wanted), n_seen
        raise AssertionError("the last step has no bound left")


def _cut(batch: pa.RecordBatch, step: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


RANKED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search_block(docs: DataFrame, asked: pa.Table, k: int, block: int) -> DataFrame | None:
    spark = docs.sparkSession
    by_item: dict[object, set[bytes]] = {}
    for name, t in zip(asked.column("item_id").to_pylist(), asked.column("text").to_pylist(), strict=True):
        by_item.setdefault(name, set()).update(terms_of(t))
    by_item = {name: own for name, own in by_item.items() if own}
    vocabulary = {w: i for i, w in enumerate(sorted({w for own in by_item.values() for w in own}))}
    if not vocabulary:
        return None
    table = materialize(forward(docs, vocabulary))
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        discard(table)
        return None
    # As many rows as the items have terms.
    df = {r.term: r.df for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([term_weight(n, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    items = [np.array(sorted(vocabulary[w] for w in own), np.int64) for own in by_item.values()]
    shipped = spark.sparkContext.broadcast((weights, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shipped.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for batch in (b for whole in batches for b in _cut(whole, block)):
            lists = batch.column("terms")
            terms, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            norms = length_norms(batch.column("n").to_numpy(), n, total)
            impacts = weights[terms] * saturation(tf, np.repeat(norms, np.diff(starts)))
            ids, unnamed = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            made = Postings(starts, terms, impacts, len(weights))
            for i, item in enumerate(items):
                scores, names, none = held[i]
                found, whole, _ = made.best(item, k, int(scores[k - 1]) if len(scores) >= k else 1)
                if len(found):
                    scores, names, none = np.append(scores, whole), np.append(names, ids[found]), np.append(none, unnamed[found])
                    order = np.lexsort((names, none, -scores))[:k]
                    order = order[scores[order] > 0]
                    held[i] = scores[order], names[order], none[order]
        which = np.repeat(np.arange(len(items)), [len(s) for s, _, _ in held])
        scores, names, none = (np.concatenate([h[j] for h in held]) for j in range(3))
        yield frame(RANKED, pa.array(which, pa.int64()), pa.array(names, pa.int64(), mask=none), pa.array(scores, pa.int64()))

    # A place in the list of items in place of its id, whatever type that has.
    names = spark.createDataFrame(list(enumerate(by_item)), f"item long, item_id {docs.sparkSession.createDataFrame([], _ddl(asked)).schema['item_id'].dataType.simpleString()}")
    return table.mapInArrow(run, "item long, doc_id long, score long").join(names, "item")


def _ddl(asked: pa.Table) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return f"item_id {from_arrow_type(asked.schema.field('item_id').type).simpleString()}"


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text), exactly."""
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    parts = []
    for b in range(blocks):
        found = _search_block(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow(), k, block)
        if found is not None:
            parts.append(found)
    if not parts:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
