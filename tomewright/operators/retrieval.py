"""Sparse, dense and hybrid retrieval: BM25, rank and score fusion, and a facade with interchangeable parts.

Ranked lists are rows (query_id, id, score, rank, strategy).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.errors import EngineError
from . import vectorstore

TOKEN = r"([\p{L}\p{N}_]+)"


@dataclass(frozen=True)
class Options:
    top_k: int = 20
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    candidates: int = 100
    k1: float = 1.2
    b: float = 0.75
    epsilon: float = 0.0
    fusion: str = "rrf"
    rrf_k: int = 60
    max_query_length: int | None = None


def corpus_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row: texts and their mean length in tokens."""
    n = F.size(F.regexp_extract_all(F.lower(column), F.lit(TOKEN), 1))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(n).alias("avg_length"))


_TOKEN = regex.compile(TOKEN)
COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64())])


def _counter(terms: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts that have each term; -1 counts texts, -2 their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts, tokens = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for t in batch.column("text"):
                own = _TOKEN.findall(t.as_py() or "")
                texts, tokens = texts + 1, tokens + len(own)
                found[[terms[w] for w in terms.keys() & set(own)]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*found[at].tolist(), texts, tokens])], schema=COUNTS)

    return run


def _scorer(asked: pa.Table, terms: dict[str, int], idf: np.ndarray, mean: float, options: Options, digits: int, k: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = asked.column("query_id").combine_chunks()
    has = np.zeros((len(terms), len(names)))
    for q, own in enumerate(asked.column("terms").to_pylist()):
        has[[terms[w] for w in own], q] = 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = vectorstore.Best(names, schema, k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                weight = np.zeros((some.num_rows, len(terms)))
                for i, t in enumerate(some.column("text").to_pylist()):
                    own = _TOKEN.findall(t or "")
                    tf = Counter(w for w in own if w in terms)
                    n = np.fromiter(tf.values(), float, len(tf))
                    weight[i, [terms[w] for w in tf]] = n * (options.k1 + 1) / (n + options.k1 * (1 - options.b + options.b * len(own) / mean)) if len(tf) else 0
                scores = np.round((weight * idf) @ has, digits).T
                met = (weight > 0).astype(np.float32) @ has.astype(np.float32) > 0
                yield best.keep(some.column("id"), np.where(met.T, scores, -np.inf))

    return run


#: Queries whose terms go to every task of a scan at once.
QUERY_BLOCK = 256


def bm25(docs: DataFrame, queries: DataFrame, options: Options = Options(), digits: int = 6, top: int | None = None) -> DataFrame:
    """(query_id, id, score): Okapi scores with idf ln(1 + (N - df + 0.5) / (df + 0.5)), not below ``epsilon``.

    Queries are a stated set: blocks of QUERY_BLOCK go to every task of two scans. The first counts texts per query
    term before anything is shuffled; the second scores whole texts in matrix products, exactly, and sends on what
    can be among the ``top`` of a query, so no table of queries by texts is ever shuffled. All pairs with a common
    term without ``top``.
    """
    asked = queries.select("query_id", F.array_distinct(text.query_tokens(F.col("text"), options.max_query_length)).alias("terms")).where(F.size("terms") > 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    texts = docs.select("id", F.lower("text").alias("text"))
    schema, ddl = vectorstore.scored_schema(queries.schema["query_id"].dataType, docs.schema["id"].dataType)
    parts = []
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        terms = {w: i for i, w in enumerate(sorted({w for own in some.column("terms").to_pylist() for w in own}))}
        if not terms:
            continue
        counts = {r.term: r.n for r in texts.select("text").mapInArrow(_counter(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n = counts.get(-1, 0)
        df = np.array([counts.get(i, 0) for i in range(len(terms))], float)
        idf = np.maximum(options.epsilon, np.log(1 + (n - df + 0.5) / (df + 0.5)))
        mean = counts.get(-2, 0) / n if n else 1.0
        parts.append(texts.mapInArrow(_scorer(some, terms, idf, mean or 1.0, options, digits, top or 1 << 40, schema), ddl))
    if not parts:
        return docs.sparkSession.createDataFrame([], ddl)
    return reduce(DataFrame.unionByName, parts)


def ranked(scored: DataFrame, strategy: str, limit: int | None = None) -> DataFrame:
    out = scored.select("query_id", "id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank"), F.lit(strategy).alias("strategy"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def normalised(lists: DataFrame) -> DataFrame:
    """Scores on 0..1 within each query and strategy; a constant list is 1."""
    w = Window.partitionBy("query_id", "strategy")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return lists.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def _weights(options: Options):
    return F.when(F.col("strategy") == "dense", F.lit(options.dense_weight)).otherwise(F.lit(options.sparse_weight))


def rrf(lists: DataFrame, options: Options = Options()) -> DataFrame:
    return lists.groupBy("query_id", "id").agg(F.round(F.sum(_weights(options) / (options.rrf_k + F.col("rank"))), 8).alias("score"))


def weighted_linear(lists: DataFrame, options: Options = Options()) -> DataFrame:
    return normalised(lists).groupBy("query_id", "id").agg(F.round(F.sum(_weights(options) * F.col("score")), 6).alias("score"))


def comb_sum(lists: DataFrame, options: Options = Options()) -> DataFrame:
    return normalised(lists).groupBy("query_id", "id").agg(F.round(F.sum("score"), 6).alias("score"))


FUSIONS: dict[str, Callable[[DataFrame, Options], DataFrame]] = {"rrf": rrf, "weighted": weighted_linear, "combsum": comb_sum}


def dense(docs: DataFrame, queries: DataFrame, options: Options, where: vectorstore.Filter | None = None) -> DataFrame:
    found = vectorstore.search(docs, queries.select("query_id", "vector"), options.candidates, where)
    return ranked(found, "dense", options.candidates)


def sparse(docs: DataFrame, queries: DataFrame, options: Options, where: vectorstore.Filter | None = None) -> DataFrame:
    kept = docs if where is None or where.is_empty() else docs.where(where.column())
    return ranked(bm25(kept, queries, options, top=options.candidates), "sparse", options.candidates)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"dense": dense, "sparse": sparse}


def register_strategy(name: str, strategy: Callable[..., DataFrame]) -> None:
    STRATEGIES[name.strip().lower()] = strategy


def strategy_of(name: str) -> Callable[..., DataFrame]:
    found = STRATEGIES.get(name.strip().lower())
    if found is None:
        raise EngineError("STRATEGY_NOT_FOUND", name)
    return found


def search(docs: DataFrame, queries: DataFrame, options: Options = Options(), where: vectorstore.Filter | None = None, strategies: dict[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """Hybrid results; a strategy of weight zero is not planned at all. ``strategies`` stand in for the registered ones.

    What goes wrong while a strategy or the fusion is planned, or runs as part of planning, is raised with its code.
    """
    if options.fusion not in FUSIONS:
        raise EngineError("FUSION_STRATEGY_NOT_FOUND", options.fusion)
    lists = []
    for name, weight in (("dense", options.dense_weight), ("sparse", options.sparse_weight)):
        if weight > 0:
            strategy = (strategies or {}).get(name) or strategy_of(name)
            lists.append(_coded(f"{name.upper()}_RETRIEVAL_ERROR", strategy, docs, queries, options, where))
    if not lists:
        raise EngineError("VALIDATION_ERROR", "no strategy has weight")
    if len(lists) == 1:
        return lists[0].where(F.col("rank") <= options.top_k)
    return _coded("FUSION_ERROR", lambda: ranked(FUSIONS[options.fusion](lists[0].unionByName(lists[1]), options), "hybrid", options.top_k))


def _coded(code: str, make: Callable[..., DataFrame], *args) -> DataFrame:
    try:
        return make(*args)
    except EngineError:
        raise
    except Exception as e:
        raise EngineError(code, str(e)[:500]) from e


def checked_queries(queries: DataFrame, max_length: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Queries that can be searched, and the others with a code and a preview of their text."""
    bad = F.coalesce(text.strip(F.col("text")) == "", F.lit(True)) | (F.length("text") > max_length)
    return queries.where(~bad), queries.where(bad).select("query_id", F.lit("INVALID_SEARCH_QUERY").alias("error_code"), text.query_preview(F.col("text")).alias("preview"))


def dense_only(docs: DataFrame, queries: DataFrame, options: Options = Options(), where=None) -> DataFrame:
    return search(docs, queries, replace(options, dense_weight=1.0, sparse_weight=0.0), where)


def sparse_only(docs: DataFrame, queries: DataFrame, options: Options = Options(), where=None) -> DataFrame:
    return search(docs, queries, replace(options, dense_weight=0.0, sparse_weight=1.0), where)


def candidates(hits: DataFrame, payload: str = "payload") -> DataFrame:
    """Search hits with a payload map as candidate rows: empty values fall through to the next source."""
    p = F.col(payload)

    def value(*keys: str, default):
        return F.coalesce(*[F.nullif(F.try_element_at(p, F.lit(k)), F.lit("")) for k in keys], default)

    return hits.select(
        value("chunk_id", default=F.col("id").cast("string")).alias("chunk_id"),
        value("document_id", default=F.col("id").cast("string")).alias("document_id"),
        F.coalesce(F.try_element_at(p, F.lit("chunk_index")).try_cast("int"), F.lit(0)).alias("chunk_index"),
        value("raw_text", "normalized_text", "text", default=F.lit("")).alias("text"),
        "score",
        "rank",
        F.try_element_at(p, F.lit("heading")).alias("heading"),
        F.try_element_at(p, F.lit("page_number")).try_cast("int").alias("page_number"),
        F.try_element_at(p, F.lit("title")).alias("title"),
        F.try_element_at(p, F.lit("category")).alias("category"),
        F.coalesce(F.split(F.nullif(F.try_element_at(p, F.lit("tags")), F.lit("")), ","), F.array().cast("array<string>")).alias("tags"),
    )


class Cache:
    """Results kept for a time and up to a count, the least recently used leaving first."""

    def __init__(self, ttl_seconds: float = 300.0, max_size: int = 100, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.max_size, self.clock = ttl_seconds, max_size, clock
        self.held: dict[object, tuple[float, DataFrame]] = {}

    def get(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        found = self.held.pop(key, None)
        if found is None or found[0] <= now:
            if found is not None:
                found[1].unpersist()
            found = (now + self.ttl, make().persist())
        self.held[key] = found
        while len(self.held) > self.max_size:
            self.held.pop(next(iter(self.held)))[1].unpersist()
        return found[1]
