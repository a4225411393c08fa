"""Vector collections with a distance and a dimension, searched exactly over cells of an index in the metric.

Rows are dealt to cells around pivots; each row keeps how far it is from its cell's pivot, and each cell between which
distances its rows lie. By the triangle inequality a query that is a given distance from the pivot cannot be nearer to a
row than the difference of both, nor have a greater dot product with it than with the pivot plus its own length times
the row's distance. So a search first goes through the cells nearest to a query, takes the k-th result as a bar, opens
no other cell that cannot reach it, and of the cells it opens multiplies no row that cannot. What is left out is
proven not to be among the results.

Pivots are fitted on a bounded sample (SAMPLE rows) by a few rounds of k-means; every row is indexed. Cells are the
buckets of a versioned table, so a change rewrites the cells of the rows it concerns and no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.versioned import Store, Unit, bucket_of
from . import vectorstore
from .vectorstore import Filter

#: Distances of a collection.
DISTANCES = ("cosine", "dot", "euclid")
#: Rows that pivots are fitted on at most.
SAMPLE = 20_000
#: Cells per collection unless told otherwise; as many centres go to every task.
N_CELLS = 64
#: Cells per query that are searched first.
SEEDS = 2
SLACK = 1e-5


class VectorError(ValueError):
    """``code`` names the kind: COLLECTION_EXISTS, COLLECTION_NOT_FOUND, VECTOR_DIMENSION_MISMATCH, INVALID_DISTANCE."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows, from the flat values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def prepared(vectors: np.ndarray, distance: str) -> np.ndarray:
    """Vectors as the metric sees them: for cosines of length one. One of length zero stays, and has no cosine."""
    if distance != "cosine":
        return vectors
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of ``a`` to each of ``b``."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def similarities(queries: np.ndarray, rows: np.ndarray, distance: str, digits: int) -> np.ndarray:
    """Higher is nearer: cosine, dot product, or the distance with its sign turned; of vectors as given."""
    if distance == "euclid":
        # Differences, not products: near rows keep their digits.
        return -np.round(np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in queries]), digits)
    found = queries @ rows.T
    if distance == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            found = found / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :])
    return np.round(found, digits)


def reachable(to_pivot: np.ndarray, query_lengths: np.ndarray, products: np.ndarray, low: np.ndarray, high: np.ndarray, distance: str) -> np.ndarray:
    """The most that the similarity can be of queries (rows) and what lies between ``low`` and ``high`` from a pivot (columns).

    ``to_pivot`` and ``products`` are the distances and dot products of queries and pivots.
    """
    if distance == "dot":
        return products + query_lengths * high
    least = np.maximum(np.maximum(to_pivot - high, low - to_pivot), 0)
    return -least if distance == "euclid" else 1 - least**2 / 2


def fitted(vectors: np.ndarray, n: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Up to ``n`` pivots for the rows of ``vectors``: k-means from rows drawn at random."""
    vectors = np.unique(vectors, axis=0)
    if not len(vectors):
        return np.zeros((1, vectors.shape[1] if vectors.ndim == 2 else 0))
    pivots = vectors[np.random.default_rng(seed).permutation(len(vectors))[:n]]
    for _ in range(rounds):
        own = apart(vectors, pivots).argmin(axis=1)
        sums, counts = np.zeros_like(pivots), np.bincount(own, minlength=len(pivots))
        np.add.at(sums, own, vectors)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


class VectorStore:
    """Named collections in one versioned folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    def exists(self, name: str) -> bool:
        return f"{name}__rows" in self.store.manifest()["tables"]

    def describe(self, name: str) -> dict:
        """Dimension, distance, cells and points of a collection."""
        if not self.exists(name):
            raise VectorError("COLLECTION_NOT_FOUND", name)
        own = self.store.read(f"{name}__about").first()
        return own.asDict() | {"points": self.store.read(f"{name}__places").count()}

    def create(self, name: str, dimension: int, distance: str = "cosine", payload: str = "", id_type: str = "long", n_cells: int = N_CELLS) -> None:
        """An empty collection; ``payload`` gives further columns as in a table's definition."""
        if distance not in DISTANCES:
            raise VectorError("INVALID_DISTANCE", distance)
        if dimension < 1 or n_cells < 1:
            raise VectorError("VECTOR_DIMENSION_MISMATCH", f"{dimension} dimensions, {n_cells} cells")
        if self.exists(name):
            raise VectorError("COLLECTION_EXISTS", name)
        more = f", {payload}" if payload else ""
        empty = self.spark.createDataFrame([], f"id {id_type}, vector array<float>{more}, cell int, away double")
        with self.store.begin() as unit:
            unit.append(f"{name}__about", self.spark.createDataFrame([(dimension, distance, n_cells)], "dimension int, distance string, n_cells int"))
            unit.append(f"{name}__rows", empty, ["cell"], n_cells)
            unit.append(f"{name}__places", empty.select("id", "cell"), ["id"], n_cells)

    def drop(self, name: str) -> bool:
        had = self.exists(name)
        with self.store.begin() as unit:
            for t in [t for t in unit.tables if t.rpartition("__")[0] == name]:
                unit.drop(t)
        return had

    def recreate(self, name: str, dimension: int, distance: str = "cosine", **more) -> None:
        self.drop(name)
        self.create(name, dimension, distance, **more)

    def read(self, name: str) -> DataFrame:
        return self.store.read(f"{name}__rows").drop("cell", "away")

    def _checked(self, about: dict, records: DataFrame) -> int:
        """Rows of ``records``; all of the collection's dimension, or none is taken."""
        wrong = F.col("vector").isNull() | (F.size("vector") != about["dimension"]) | F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))
        n, bad, repeated = records.agg(F.count(F.lit(1)), F.count_if(wrong), F.count(F.lit(1)) - F.count_distinct("id")).first()
        if bad:
            raise VectorError("VECTOR_DIMENSION_MISMATCH", f"{bad} of {n} vectors are not {about['dimension']} numbers")
        if repeated:
            raise VectorError("REPEATED_ID", f"{repeated} records repeat an id or have none")
        return n

    def _celled(self, rows: DataFrame, pivots: np.ndarray, distance: str) -> DataFrame:
        """``rows`` with the cell of the nearest pivot and the distance to it."""
        shipped = self.spark.sparkContext.broadcast(pivots)

        @F.arrow_udf("struct<cell: int, away: double>")
        def place(vectors: pa.Array) -> pa.Array:
            if not len(vectors):
                return pa.array([], pa.struct([("cell", pa.int32()), ("away", pa.float64())]))
            far = apart(prepared(_matrix(vectors), distance), shipped.value)
            own = far.argmin(axis=1)
            return pa.StructArray.from_arrays([pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], ["cell", "away"])

        return rows.withColumn("_p", place("vector")).withColumns({"cell": F.col("_p.cell"), "away": F.col("_p.away")}).drop("_p")

    def _pivots(self, unit: Unit, name: str, about: dict, rows: DataFrame) -> np.ndarray:
        """The stored pivots; of a collection that has none yet those of its first rows."""
        table = f"{name}__pivots"
        if unit.has(table):
            return np.array([r.pivot for r in unit.read(table).orderBy("cell").collect()])
        sample = rows.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
        pivots = fitted(prepared(_matrix(sample.column("vector")), about["distance"]), about["n_cells"])
        unit.append(table, self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>"))
        return pivots

    def _put(self, unit: Unit, name: str, about: dict, records: DataFrame) -> None:
        names = [c for c in unit.read(f"{name}__rows").columns if c not in ("cell", "away")]
        rows = self._celled(records.select(*names), self._pivots(unit, name, about, records), about["distance"])
        new = unit.append(f"{name}__rows", rows.select(*names, "cell", "away"))
        unit.append(f"{name}__places", new.select("id", "cell"))
        # Bounds are only ever widened: rows that leave make them looser, not wrong.
        unit.append(f"{name}__reach", new.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high")))

    def _take(self, unit: Unit, name: str, ids: DataFrame) -> int:
        """Take rows out of their cells, which alone are rewritten; how many there were."""
        places, rows = f"{name}__places", f"{name}__rows"
        buckets = unit.touched(places, ids)
        if not buckets or not unit.tables[rows]["parts"]:
            return 0
        hit = unit.read(places, buckets).join(ids.select("id").distinct(), "id", "left_semi")
        entry = unit.tables[rows]
        cells = sorted(r.b for r in hit.select(bucket_of(["cell"], entry["n_buckets"]).alias("b")).distinct().collect())
        if not cells:
            return 0
        n = hit.count()
        old = unit.read(rows, cells)
        unit.rewrite(rows, cells, old.join(ids.select("id").distinct(), "id", "left_anti").select(*old.columns))
        unit.delete(places, ids)
        return n

    def upsert(self, name: str, records: DataFrame) -> int:
        """``records`` (id, vector, payload) replace rows of their id; how many they are. A wrong dimension rejects all."""
        about = self.describe(name)
        n = self._checked(about, records)
        if n:
            with self.store.begin() as unit:
                self._take(unit, name, records)
                self._put(unit, name, about, records)
        return n

    def delete(self, name: str, ids: DataFrame) -> int:
        if not self.exists(name):
            raise VectorError("COLLECTION_NOT_FOUND", name)
        with self.store.begin() as unit:
            return self._take(unit, name, ids)

    def recell(self, name: str) -> None:
        """Fit pivots to the rows there are now, and deal these anew."""
        about = self.describe(name)
        with self.store.begin() as unit:
            rows = unit.read(f"{name}__rows").drop("cell", "away")
            for t in ("pivots", "reach"):
                unit.drop(f"{name}__{t}")
            celled = self._celled(rows, self._pivots(unit, name, about, rows), about["distance"])
            unit.replace(f"{name}__rows", celled)
            new = unit.read(f"{name}__rows")
            unit.replace(f"{name}__places", new.select("id", "cell"))
            unit.append(f"{name}__reach", new.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high")))

    def search(self, name: str, queries: DataFrame, k: int = 10, where: Filter | None = None, digits: int = 6) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` nearest rows per query (query_id, vector), exactly; ties by id.

        The score is the cosine, the dot product or the distance. Filters hold before the nearest are taken.
        """
        return self._search(name, queries, k, where, digits)[0]

    def work(self, name: str, queries: DataFrame, k: int = 10) -> dict[str, int]:
        """Pairs of a query and a row that a search multiplies after its first cells, and all there are."""
        _, rows, jobs = self._search(name, queries, k, None, 6)
        done = sum(rows.mapInArrow(_count(job), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for job in jobs)
        return {"pairs": rows.count() * queries.where("vector IS NOT NULL").count(), "multiplied": done}

    def _search(self, name: str, queries: DataFrame, k: int, where: Filter | None, digits: int):
        version = self.store.version()
        about = self.describe(name)
        wrong = queries.where(F.size("vector") != about["dimension"]).count()
        if wrong:
            raise VectorError("VECTOR_DIMENSION_MISMATCH", f"{wrong} queries are not of {about['dimension']} dimensions")
        table = f"{name}__rows"
        all_rows = self.store.read(table, version=version)
        schema, ddl = vectorstore.scored_schema(queries.schema["query_id"].dataType, all_rows.schema["id"].dataType)
        empty = self.spark.createDataFrame([], ddl + ", rank int")
        if f"{name}__pivots" not in self.store.manifest(version)["tables"]:
            return empty, all_rows, []
        reach = self.store.read(f"{name}__reach", version=version).groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        cells = self.store.read(f"{name}__pivots", version=version).join(reach, "cell").orderBy("cell").collect()
        n_buckets = self.store.manifest(version)["tables"][table]["n_buckets"]
        bucket = {r.cell: r.b for r in reach.select("cell", bucket_of(["cell"], n_buckets).alias("b")).collect()}
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        blocks = max(1, -(-queries.count() // vectorstore.QUERY_BLOCK))
        parts, jobs = [], []
        for b in range(blocks):
            asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).where("vector IS NOT NULL").select("query_id", "vector").toArrow()
            if not asked.num_rows or not cells:
                continue
            job = _Job(asked, cells, about["distance"], digits, k)
            seeds = np.argsort(-job.bounds, axis=1, kind="stable")[:, :SEEDS]
            chosen = np.zeros(job.bounds.shape, bool)
            np.put_along_axis(chosen, seeds, True, axis=1)
            first = self._scan(table, version, cells, bucket, job, chosen, schema, ddl, where)
            bar = np.full(asked.num_rows, -np.inf)
            place = {v: i for i, v in enumerate(asked.column("query_id").to_pylist())}
            for r in first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).collect():
                bar[place[r.query_id]] = r.score
            job = job.barred(bar)
            parts.append(self._scan(table, version, cells, bucket, job, job.bounds >= bar[:, None] - SLACK, schema, ddl, where))
            jobs.append(job)
        if not parts:
            return empty, all_rows, jobs
        found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return (found.withColumn("score", -F.col("score")) if about["distance"] == "euclid" else found), all_rows, jobs

    def _scan(self, table: str, version: int, cells: list, bucket: dict, job: _Job, chosen: np.ndarray, schema: pa.Schema, ddl: str, where: Filter | None) -> DataFrame:
        """Best rows of the cells that any query needs; buckets of no such cell are not opened."""
        opened = [r.cell for r, some in zip(cells, chosen.any(axis=0), strict=True) if some]
        rows = self.store.read(table, {bucket[c] for c in opened}, version).where(F.col("cell").isin(opened))
        rows = rows if where is None or where.is_empty() else rows.where(where.column())
        return rows.select("id", "vector", "cell", "away").mapInArrow(_best(job, chosen, schema), ddl)


class _Job:
    """A block of queries with the cells' bounds."""

    def __init__(self, asked: pa.Table, cells: list, distance: str, digits: int, k: int) -> None:
        self.names = asked.column("query_id").combine_chunks()
        self.given = _matrix(asked.column("vector"))
        self.distance, self.digits, self.k = distance, digits, k
        self.cells = np.array([r.cell for r in cells])
        pivots = np.array([r.pivot for r in cells])
        own = prepared(self.given, distance)
        self.lengths = np.linalg.norm(own, axis=1)
        self.to_pivot, self.products = apart(own, pivots), own @ pivots.T
        self.bounds = self.most(np.arange(len(cells)), np.array([r.low for r in cells]), np.array([r.high for r in cells]))
        self.bar = np.full(len(self.names), -np.inf)

    def most(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bounds of queries by rows; ``at`` is the place of a row's cell."""
        return reachable(self.to_pivot[:, at], self.lengths[:, None], self.products[:, at], low[None, :], high[None, :], self.distance)

    def barred(self, bar: np.ndarray) -> _Job:
        self.bar = bar
        return self

    def pieces(self, batches: Iterator[pa.RecordBatch], bar: np.ndarray, chosen: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, queries, which pairs can reach the bar) of one cell after another."""
        place = np.full(int(self.cells.max()) + 1, -1)
        place[self.cells] = np.arange(len(self.cells))
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                some = batch.slice(begin, 4096)
                at = place[some.column("cell").to_numpy()]
                away = some.column("away").to_numpy()
                for c in np.unique(at).tolist():
                    own = np.flatnonzero(at == c)
                    can = self.most(np.full(len(own), c), away[own], away[own]) >= bar[:, None] - SLACK
                    if chosen is not None:
                        can &= chosen[:, c, None]
                    queries, rows = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
                    if len(queries) and len(rows):
                        yield some.take(pa.array(own[rows])), queries, can[np.ix_(queries, rows)]


def _best(job: _Job, chosen: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = vectorstore.Best(job.names, schema, job.k)
        best.bar = job.bar.copy()
        for rows, queries, can in job.pieces(batches, best.bar, chosen):
            found = similarities(job.given[queries], _matrix(rows.column("vector")), job.distance, job.digits)
            scores = np.full((len(job.names), rows.num_rows), -np.inf)
            scores[queries] = np.where(can, found, -np.inf)
            yield best.keep(rows.column("id"), scores)

    return run


def _count(job: _Job):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(queries) * rows.num_rows for rows, queries, _ in job.pieces(batches, job.bar))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], schema=pa.schema([("n", pa.int64())]))

    return run
