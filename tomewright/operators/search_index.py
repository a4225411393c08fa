"""BM25 over a stored inverted index: postings in blocks with their maxima, changed per document, searched by bounds.

Documents are dealt to blocks of BLOCK texts of like length. A posting row holds a term's documents of one block with
the greatest number of occurrences and the least length among them, which bound its share of any score in the block,
whatever the corpus' mean length becomes. Rows are stored by a hash of their term, so a search opens the buckets of
its own terms only. It first sums bounds per query and block, scores a few blocks of the highest bounds exactly, and
then only those blocks whose bound reaches a query's k-th score: results are those of a scan.

New documents add blocks; deleted ones are noted per block, and taken out of document frequencies and lengths by
negative counts, from the terms that are stored by document. An update is both in one unit, so a reader sees either the
old text or the new one. ``compact`` writes all blocks anew.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..sources.versioned import Conflict, Store, Unit, bucket_of
from . import retrieval, vectorstore

#: Documents of a block.
BLOCK = 1024
#: Blocks per query that are scored first, for a k-th score to hold others against.
SEEDS = 4
#: Blocks up to which bounds cost more than they save, so that all are scored at once.
FEW_BLOCKS = 64
#: Scores are rounded, so a bound this much below the k-th score may still belong to it.
SLACK = 1e-5
#: Documents per bucket of terms, and between how many buckets a new index is dealt.
PER_BUCKET = 20_000
BUCKETS = (4, 1024)


def _analysed(docs: DataFrame) -> DataFrame:
    """(id, length, terms, tfs) per document (id, text)."""
    id_type = docs.schema["id"].dataType
    ddl = f"id {id_type.simpleString()}, length int, terms array<string>, tfs array<int>"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                own = [retrieval._TOKEN.findall(t or "") for t in some.column("text").to_pylist()]
                counts = [Counter(w) for w in own]
                columns = [some.column("id"), pa.array([len(w) for w in own], pa.int32()), pa.array([list(c) for c in counts]), pa.array([list(c.values()) for c in counts])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("id", F.lower("text").alias("text")).mapInArrow(run, ddl)


def _blocked(documents: DataFrame, version: int) -> DataFrame:
    """Documents of like length in blocks, whose numbers are made of version, partition and place in the partition."""
    ordered = documents.repartitionByRange("length").sortWithinPartitions("length").withColumn("_at", F.monotonically_increasing_id())
    place = F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / BLOCK)
    return ordered.select("id", "length", "terms", "tfs", (F.lit(version << 44) + F.shiftleft(F.shiftright("_at", 33), 24) + place).cast("long").alias("block"))


def _postings(documents: DataFrame) -> DataFrame:
    """A row per term and block: the forward rows of one block after another are turned round."""
    id_type = documents.schema["id"].dataType.simpleString()
    ddl = f"term string, block long, ids array<{id_type}>, lengths array<int>, tfs array<int>, max_tf int, min_length int"
    schema = to_arrow_schema(documents.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            lists = table.column("terms").combine_chunks()
            if not len(lists.flatten()):
                continue
            terms = lists.flatten().dictionary_encode()
            codes = terms.indices.to_numpy()
            row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(codes, kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(terms.dictionary)))))
            tf = table.column("tfs").combine_chunks().flatten().to_numpy()[order]
            length = table.column("length").to_numpy()[row[order]]
            offsets = pa.array(starts, pa.int32())
            columns = [
                terms.dictionary, pa.array(np.full(len(terms.dictionary), table.column("block")[0].as_py())), pa.ListArray.from_arrays(offsets, table.column("id").combine_chunks().take(pa.array(row[order]))),
                pa.ListArray.from_arrays(offsets, pa.array(length)), pa.ListArray.from_arrays(offsets, pa.array(tf)), pa.array(np.maximum.reduceat(tf, starts[:-1])), pa.array(np.minimum.reduceat(length, starts[:-1])),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _by_block(documents.select("block", "id", "length", "terms", "tfs")).mapInArrow(run, ddl)


def saturated(tf: np.ndarray, length: np.ndarray, mean: float, options: retrieval.Options) -> np.ndarray:
    return tf * (options.k1 + 1) / (tf + options.k1 * (1 - options.b + options.b * length / mean))


class _Asked:
    """A block of queries as the tasks need it: terms with their idf, and the terms of each query."""

    def __init__(self, names: pa.Array, of: list[list[int]], terms: dict[str, int], idf: np.ndarray, mean: float, options: retrieval.Options, n_docs: int) -> None:
        self.n_docs = n_docs
        self.names, self.of, self.terms, self.idf, self.mean, self.options = names, [np.array(t, np.int64) for t in of], terms, idf, mean, options

    def bounds(self, places: np.ndarray, max_tf: np.ndarray, min_length: np.ndarray) -> np.ndarray:
        """Per query the most that a document of a block can score; the block's terms by ``places``."""
        value = np.zeros(len(self.terms))
        value[places] = self.idf[places] * saturated(max_tf, min_length, self.mean, self.options)
        return np.array([value[t].sum() for t in self.of])


def _by_block(rows: DataFrame) -> DataFrame:
    """A block's rows in one task, one after another.

    Dealt by a hash of their own: dealing by the column itself is left out of a plan whose join already deals by it, and
    where that join turns to a broadcast while it runs, a block's rows stay wherever they were read.
    """
    return rows.repartition(F.xxhash64("block")).sortWithinPartitions("block")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after another, from rows in the order of their block."""
    held: list[pa.Table] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        blocks = table.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and blocks[begin] != now:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            now = blocks[begin]
            held.append(table.slice(begin, end - begin))
    if held:
        yield pa.concat_tables(held).combine_chunks()


class SearchIndex:
    """A stored index at ``path``; ids are unique among its documents."""

    def __init__(self, spark: SparkSession, path: str, options: retrieval.Options = retrieval.Options()) -> None:
        self.spark, self.store, self.options = spark, Store(spark, path), options

    def exists(self) -> bool:
        return self.store.version() > 0

    def _add(self, unit: Unit, docs: DataFrame) -> None:
        version = unit.base["version"] + 1
        n_buckets = 0 if unit.has("documents") else max(BUCKETS[0], min(BUCKETS[1], -(-docs.count() // PER_BUCKET)))
        new = unit.append("documents", _blocked(_analysed(docs), version), ["id"], n_buckets)
        unit.append("postings", _postings(new), ["term"], n_buckets)
        self._count(unit, new, 1)

    def _count(self, unit: Unit, documents: DataFrame, sign: int) -> None:
        df = documents.select(F.explode("terms").alias("term")).groupBy("term").agg((sign * F.count(F.lit(1))).alias("df"))
        unit.append("frequencies", df, ["term"], unit.tables["postings"]["n_buckets"])
        unit.append("totals", documents.agg((sign * F.count(F.lit(1))).alias("n_docs"), F.coalesce(sign * F.sum("length"), F.lit(0)).cast("long").alias("n_tokens")))

    def _remove(self, unit: Unit, ids: DataFrame) -> None:
        if not unit.has("documents"):
            return
        buckets = unit.touched("documents", ids)
        if not buckets:
            return
        hit = unit.read("documents", buckets).join(ids.select("id").distinct(), "id", "left_semi")
        gone = unit.append("gone", hit.select("block", "id", "length", "terms"))
        self._count(unit, gone, -1)
        unit.delete("documents", ids)

    def add(self, docs: DataFrame) -> int:
        """Documents (id, text) that are new or replace those of their id, in one unit; the new version."""
        with self.store.begin() as unit:
            self._remove(unit, docs)
            self._add(unit, docs)
        return unit.version

    def delete(self, ids: DataFrame) -> int | None:
        with self.store.begin() as unit:
            self._remove(unit, ids)
        return unit.version

    def compact(self) -> int:
        """All live documents in new blocks, without what was deleted."""
        with self.store.begin() as unit:
            live = unit.read("documents")
            for t in ("postings", "frequencies", "totals", "gone"):
                unit.drop(t)
            version = unit.base["version"] + 1
            unit.replace("documents", _blocked(live.drop("block"), version))
            new = unit.read("documents")
            unit.append("postings", _postings(new), ["term"], unit.tables["documents"]["n_buckets"])
            self._count(unit, new, 1)
        return unit.version

    def of_terms(self, table: str, terms: list[str], version: int | None = None) -> DataFrame:
        """Rows of a table by term, from the buckets of these terms alone."""
        manifest = self.store.manifest(version)
        n_buckets = manifest["tables"][table]["n_buckets"]
        buckets = None
        if len(terms) < 4 * n_buckets:
            t = self.spark.createDataFrame([(w,) for w in terms], "term string")
            buckets = [r.b for r in t.select(bucket_of(["term"], n_buckets).alias("b")).distinct().collect()]
        # Terms are letters, digits and underscores; one expression is made much faster than as many literals.
        return self.store._read(manifest, table, buckets).where("term IN (" + ", ".join(f"'{w}'" for w in terms) + ")")

    def _asked(self, queries: DataFrame, version: int) -> _Asked | None:
        rows = queries.toArrow()
        lists = rows.column("terms").to_pylist()
        terms = {w: i for i, w in enumerate(sorted({w for own in lists for w in own}))}
        if not terms:
            return None
        # A row without a term has the totals.
        totals = self.store.read("totals", version=version).select(F.lit(None).cast("string").alias("term"), F.col("n_docs").alias("df"), "n_tokens")
        counted = self.of_terms("frequencies", list(terms), version).select("term", "df", F.lit(0).cast("long").alias("n_tokens")).unionByName(totals)
        found = {r.term: (r.df, r.tokens) for r in counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_tokens").alias("tokens")).collect()}
        n, tokens = found.get(None, (0, 0))
        df = np.array([found.get(w, (0, 0))[0] for w in terms], float)
        idf = np.maximum(self.options.epsilon, np.log(1 + (n - df + 0.5) / (df + 0.5)))
        return _Asked(rows.column("query_id").combine_chunks(), [[terms[w] for w in own] for own in lists], terms, idf, (tokens / n if n else 1.0) or 1.0, self.options, n)

    def _bounds(self, asked: _Asked, version: int, bar: np.ndarray | None, keep: int | None) -> DataFrame:
        """(query, block, bound): blocks at a query's ``bar`` or above, or per task its ``keep`` best ones. Lists are not read for it."""
        rows = self.of_terms("postings", list(asked.terms), version).select("block", "term", "max_tf", "min_length")
        schema = pa.schema([("query", pa.int32()), ("block", pa.int64()), ("bound", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[float, int]]] = [[] for _ in asked.of]
            for table in _runs(batches):
                places = np.array([asked.terms[w] for w in table.column("term").to_pylist()])
                bound = asked.bounds(places, table.column("max_tf").to_numpy(), table.column("min_length").to_numpy())
                block = table.column("block")[0].as_py()
                if bar is not None:
                    at = np.flatnonzero((bound >= bar - SLACK) & (bound > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), block)), pa.array(bound[at])], schema=schema)
                else:
                    for q in np.flatnonzero(bound > 0).tolist():
                        best[q] = sorted([*best[q], (float(bound[q]), block)], reverse=True)[:keep]
            if bar is None:
                flat = [(q, b, v) for q, own in enumerate(best) for v, b in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(schema.types)], schema=schema)

        return _by_block(rows).mapInArrow(run, "query int, block long, bound double")

    def _scored(self, asked: _Asked, version: int, blocks: DataFrame | None, bar: np.ndarray, k: int, digits: int, schema: pa.Schema, ddl: str) -> DataFrame:
        """(query_id, id, score) of what may be among the ``k`` best, in some blocks (block) or in all."""
        rows = self.of_terms("postings", list(asked.terms), version).select("block", "term", "ids", "lengths", "tfs")
        rows = rows if blocks is None else rows.join(blocks, "block", "left_semi")
        if "gone" in self.store.manifest(version)["tables"]:
            gone = self.store.read("gone", version=version)
            gone = (gone if blocks is None else gone.join(blocks, "block", "left_semi")).groupBy("block").agg(F.collect_list("id").alias("ids"))
            none = F.array().cast("array<int>")
            rows = rows.unionByName(gone.select("block", F.lit(None).cast("string").alias("term"), "ids", none.alias("lengths"), none.alias("tfs")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = vectorstore.Best(asked.names, schema, k)
            best.bar = bar.copy()
            for table in _runs(batches):
                dead = table.filter(table.column("term").is_null())
                live = table.filter(table.column("term").is_valid())
                if not live.num_rows:
                    continue
                terms = live.column("term").to_pylist()
                places = np.array([asked.terms[w] for w in terms])
                lists = live.column("ids").combine_chunks()
                names = lists.flatten().dictionary_encode()
                term_of = np.repeat(np.arange(len(terms)), np.diff(lists.offsets.to_numpy()))
                tf, length = (live.column(c).combine_chunks().flatten().to_numpy().astype(float) for c in ("tfs", "lengths"))
                bound = asked.bounds(places, np.maximum.reduceat(tf, lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()), np.minimum.reduceat(length, lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()))
                share = np.zeros((len(asked.terms), len(names.dictionary)))
                share[places[term_of], names.indices.to_numpy()] = asked.idf[places[term_of]] * saturated(tf, length, asked.mean, asked.options)
                scores = np.full((len(asked.of), len(names.dictionary)), -np.inf)
                for q in np.flatnonzero((bound >= best.bar - SLACK) & (bound > 0)).tolist():
                    whole = share[asked.of[q]].sum(axis=0)
                    scores[q] = np.where(whole > 0, np.round(whole, digits), -np.inf)
                if dead.num_rows:
                    away = names.dictionary.to_pylist()
                    lost = {x for own in dead.column("ids").to_pylist() for x in own}
                    scores[:, [i for i, x in enumerate(away) if x in lost]] = -np.inf
                yield best.keep(names.dictionary, scores)

        return _by_block(rows).mapInArrow(run, ddl)

    def search(self, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
        """(query_id, id, score): the ``k`` best documents of each query (query_id, text), exactly; ties by id."""
        version = self.store.version()
        asked_all = queries.select("query_id", F.array_distinct(text.query_tokens(F.col("text"), self.options.max_query_length)).alias("terms")).where(F.size("terms") > 0)
        blocks = max(1, -(-queries.count() // retrieval.QUERY_BLOCK))
        id_type = self.store.read("documents", version=version).schema["id"].dataType
        schema, ddl = vectorstore.scored_schema(queries.schema["query_id"].dataType, id_type)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        parts = []
        for b in range(blocks):
            asked = self._asked(asked_all.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), version)
            if asked is None:
                continue
            if asked.n_docs <= FEW_BLOCKS * BLOCK:
                bar, keep = np.full(len(asked.of), -np.inf), None
            else:
                bar, _ = self._bar(asked, version, k, digits, schema, ddl)
                keep = self._bounds(asked, version, bar, None).select("block").distinct()
            parts.append(self._scored(asked, version, keep, bar, k, digits, schema, ddl).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ddl)

    def _bar(self, asked: _Asked, version: int, k: int, digits: int, schema: pa.Schema, ddl: str) -> tuple[np.ndarray, int]:
        """The k-th score of each query in the blocks of the highest bounds, and how many these are."""
        best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        seeds = self._bounds(asked, version, None, SEEDS).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= SEEDS).select("block").distinct().collect()
        blocks = self.spark.createDataFrame([(r.block,) for r in seeds], "block long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        bar = np.full(len(asked.of), -np.inf)
        kth = self._scored(asked, version, blocks, bar, k, digits, schema, ddl).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).collect()
        place = {name: i for i, name in enumerate(asked.names.to_pylist())}
        for r in kth:
            bar[place[r.query_id]] = r.score
        return bar, len(seeds)

    def work(self, queries: DataFrame, k: int = 10) -> dict[str, int]:
        """Pairs of a query and a block that share a term, and those of them that a search scores after its first blocks."""
        version = self.store.version()
        asked = self._asked(queries.select("query_id", F.array_distinct(text.query_tokens(F.col("text"), self.options.max_query_length)).alias("terms")), version)
        schema, ddl = vectorstore.scored_schema(queries.schema["query_id"].dataType, self.store.read("documents", version=version).schema["id"].dataType)
        bar, _ = self._bar(asked, version, k, 6, schema, ddl)
        return {"pairs": self._bounds(asked, version, np.full(len(asked.of), -np.inf), None).count(), "scored": self._bounds(asked, version, bar, None).count()}

    def strategy(self) -> Callable[..., DataFrame]:
        """The index as the facade's sparse strategy; filters on columns are not in the index."""

        def sparse(docs: DataFrame, queries: DataFrame, options: retrieval.Options, where: vectorstore.Filter | None = None) -> DataFrame:
            if where is not None and not where.is_empty():
                raise ValueError("INVALID_FILTER: the index has no payload columns")
            return retrieval.ranked(self.search(queries, options.candidates), "sparse", options.candidates)

        return sparse


def opened(spark: SparkSession, docs: DataFrame, path: str, options: retrieval.Options = retrieval.Options()) -> SearchIndex:
    """The index at ``path``, made of ``docs`` where there is none yet."""
    index = SearchIndex(spark, path, options)
    if not index.exists():
        try:
            index.add(docs)
        except Conflict:
            # Another session has made it meanwhile.
            return index
    return index
