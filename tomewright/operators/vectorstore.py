"""Vector collections as tables (id, vector, payload columns): search, upsert, delete, lookup, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from ..functions import vectors

#: Queries up to this count are sent to every task of a scan; more are searched in blocks of as many.
QUERY_BLOCK = 1024


class Filter:
    """Conditions on payload columns, all of which must hold; a missing value does not match."""

    def __init__(self) -> None:
        self.conditions: list[Column] = []

    def equals(self, column: str, value: object) -> Filter:
        self.conditions.append(F.col(column) == F.lit(value))
        return self

    def one_of(self, column: str, values: list) -> Filter:
        self.conditions.append(F.col(column).isin(values))
        return self

    def between(self, column: str, low: object, high: object) -> Filter:
        self.conditions.append(F.col(column).between(low, high))
        return self

    def document(self, document_id: object) -> Filter:
        return self.equals("document_id", document_id)

    def is_empty(self) -> bool:
        return not self.conditions

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, self.conditions, F.lit(True))


def search(collection: DataFrame, queries: DataFrame, k: int = 10, where: Filter | None = None, least_score: float | None = None, digits: int = 6) -> DataFrame:
    """The ``k`` most similar rows per query (query_id, vector): query_id, id, score, rank. Exact.

    Queries are a stated set: blocks of QUERY_BLOCK of them go to every task of a scan, which scores its rows in
    matrix products and keeps what can be among the best ``k``. So what is held follows the block, and what is
    shuffled follows tasks and queries, not rows times queries.
    """
    rows = collection if where is None or where.is_empty() else collection.where(where.column())
    rows = rows.where("vector IS NOT NULL").select("id", "vector")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    schema, ddl = scored_schema(queries.schema["query_id"].dataType, rows.schema["id"].dataType)
    parts = []
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).where("vector IS NOT NULL").select("query_id", "vector").toArrow()
        if asked.num_rows:
            parts.append(rows.mapInArrow(_best_rows(asked, schema, k, least_score, digits), ddl))
    if not parts:
        return rows.sparkSession.createDataFrame([], ddl + ", rank int")
    merged = reduce(DataFrame.unionByName, parts)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _matrix(vectors_: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = vectors_.combine_chunks() if isinstance(vectors_, pa.ChunkedArray) else vectors_
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class Best:
    """What can be among the ``k`` best of each query (``names``), from score matrices of queries by rows."""

    def __init__(self, names: pa.Array, schema: pa.Schema, k: int, least: float | None = None) -> None:
        self.names, self.schema, self.k = names, schema, k
        # The k-th best score of each query so far in this task: what is below it can not be among the best.
        self.bar = np.full(len(names), -np.inf if least is None else least)

    def keep(self, ids: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
        """(query_id, id, score) of the scores at the bar or above; those that are not finite are none."""
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        if scores.shape[1] > self.k:
            self.bar = np.maximum(self.bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        query, row = np.nonzero((scores >= self.bar[:, None]) & (scores > -np.inf))
        value = scores[query, row]
        rank_of_id = np.empty(len(ids), np.int64)
        rank_of_id[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank_of_id[row], -value, query))
        query, row, value = query[order], row[order], value[order]
        # Ties at the bar may be many; the k least ids of each query are enough.
        few = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        columns = [self.names.take(pa.array(query[few])), ids.take(pa.array(row[few])), pa.array(value[few])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def scored_schema(query_id: DataType, id_: DataType) -> tuple[pa.Schema, str]:
    fields = StructType([StructField("query_id", query_id), StructField("id", id_), StructField("score", DoubleType())])
    return to_arrow_schema(fields), f"query_id {query_id.simpleString()}, id {id_.simpleString()}, score double"


def _best_rows(asked: pa.Table, schema: pa.Schema, k: int, least: float | None, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, wanted = asked.column("query_id").combine_chunks(), _matrix(asked.column("vector"))
    lengths = np.linalg.norm(wanted, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(names, schema, k, least)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                own = _matrix(some.column("vector"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.round(wanted @ own.T / (lengths[:, None] * np.linalg.norm(own, axis=1)), digits)
                yield best.keep(some.column("id"), scores)

    return run


def search_one(collection: DataFrame, vector: Column, k: int = 10, where: Filter | None = None, least_score: float | None = None, digits: int = 6) -> DataFrame:
    """The ``k`` rows most similar to one vector: a scan and a top-k, no join."""
    rows = collection if where is None or where.is_empty() else collection.where(where.column())
    scored = rows.withColumn("score", F.round(vectors.cosine(F.col("vector"), vector), digits))
    if least_score is not None:
        scored = scored.where(F.col("score") >= least_score)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def upsert(collection: DataFrame, records: DataFrame, order: str | None = None) -> DataFrame:
    """``records`` replace rows of their id; of several records with one id the last by ``order`` counts, else the one of the greatest hash."""
    content = F.xxhash64(*collection.columns)
    last = [F.desc(order), F.desc(content)] if order is not None else [F.desc(content)]
    records = records.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*last))).where("_r = 1").select(*collection.columns)
    return collection.join(records.select("id"), "id", "left_anti").unionByName(records)


def delete(collection: DataFrame, ids: DataFrame) -> DataFrame:
    return collection.join(ids.select("id"), "id", "left_anti")


def delete_where(collection: DataFrame, where: Filter) -> DataFrame:
    return collection.where(~F.coalesce(where.column(), F.lit(False)))


def by_ids(collection: DataFrame, ids: DataFrame, with_vectors: bool = False) -> DataFrame:
    found = collection.join(ids.select("id").distinct(), "id", "left_semi")
    return found if with_vectors else found.drop("vector")


def scroll(collection: DataFrame, where: Filter | None = None, limit: int = 100, offset: int = 0, with_vectors: bool = False) -> DataFrame:
    rows = collection if where is None or where.is_empty() else collection.where(where.column())
    rows = rows if with_vectors else rows.drop("vector")
    return rows.orderBy("id").offset(offset).limit(limit)


def statistics(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count(F.lit(1)).alias("points"), F.min(F.size("vector")).alias("min_dimension"), F.max(F.size("vector")).alias("max_dimension"))


class Collections:
    """Named collections. Each change writes a new table and then points a view at it, in one step: readers see old or new.

    The view outlives a failed change; the table before last is dropped with the next change.
    """

    def __init__(self, spark: SparkSession, prefix: str = "vectors_") -> None:
        self.spark, self.prefix = spark, prefix

    def _view(self, name: str) -> str:
        return f"{self.prefix}{name}"

    def _tables(self, name: str) -> list[str]:
        head = f"{self._view(name)}__v".lower()
        found = [t.name for t in self.spark.catalog.listTables() if t.name.lower().startswith(head) and t.name[len(head) :].isdigit()]
        return sorted(found, key=lambda t: int(t[len(head) :]))

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._view(name))

    def create(self, name: str, schema: str = "id string, vector array<float>, document_id string") -> None:
        if self.exists(name):
            raise ValueError(f"collection {name} exists")
        self.replace(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str) -> bool:
        had = self.exists(name)
        self.spark.sql(f"DROP VIEW IF EXISTS {self._view(name)}")
        for table in self._tables(name):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return had

    def recreate(self, name: str, **kw) -> None:
        self.drop(name)
        self.create(name, **kw)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._view(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        old = self._tables(name)
        head = f"{self._view(name)}__v"
        new = f"{head}{int(old[-1][len(head) :]) + 1 if old else 1}"
        rows.write.saveAsTable(new)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._view(name)} AS SELECT * FROM {new}")
        for table in old[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def upsert(self, name: str, records: DataFrame, order: str | None = None) -> int:
        n = records.select("id").distinct().count()
        if n:
            self.replace(name, upsert(self.read(name), records, order))
        return n

    def delete(self, name: str, where: Filter) -> int:
        """Rows deleted, by one count of those that the filter takes."""
        n = self.read(name).where(where.column()).count()
        if n:
            self.replace(name, delete_where(self.read(name), where))
        return n
