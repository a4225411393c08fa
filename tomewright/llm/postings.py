"""What the pair-finding operators share: postings dealt to tasks as bounded units of work, and rows read by unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = ["part", "left", "right"]


def units(rows: DataFrame, by: list[str], node: str, block: int) -> DataFrame:
    """``rows`` of the postings (``by``) that two or more share, with part, left and right.

    A posting above ``block`` rows is cut into parts by a hash of ``node``, and each pair of parts (left <= right) is
    one unit of work; a part is in as many units as there are parts. So no task holds more than two parts, and
    all pairs of a posting still meet, those of two parts once.
    """
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    parts = F.ceil(F.col("n_rows") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), node), parts).cast("int")
    met = rows.join(counts, by).select(*rows.columns, own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return met.select(*rows.columns, "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"))


def by_unit(rows: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "left", "right"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def read_units(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole units of two or more, about ``rows`` rows at once, with the end of the unit of each row; from rows in the order of ``by_unit``."""
    held: list[pa.RecordBatch] = []
    size = 0

    def ends(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in (*by, "left", "right")])
        cuts = np.append(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1, table.num_rows)
        return cuts[np.searchsorted(cuts, np.arange(table.num_rows), side="right")]

    def shared(table: pa.Table, upto: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        many = np.bincount(upto, minlength=len(upto) + 1)[upto] > 1
        if many.any():
            place = np.cumsum(many)
            yield table.filter(pa.array(many)), place[upto[many] - 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            upto = ends(table)
            whole = int(np.searchsorted(upto, table.num_rows))
            if whole:
                yield from shared(table.slice(0, whole), upto[:whole])
            held = table.slice(whole).to_batches()
            size -= whole
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from shared(table, ends(table))


def spans(upto: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each unit, from the end of the unit of each row."""
    stops = np.unique(upto).tolist()
    return list(zip([0, *stops[:-1]], stops, strict=True))
