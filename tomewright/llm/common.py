"""What the corpus operators share: written intermediate tables and Arrow row access."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters outside this class (space, tab, line feed, VT, FF, CR).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a single machine only, one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "tomewright-checkpoints")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; tables of hashes need no ``dictionary``.

    That cuts the lineage: a lost executor costs the tasks it ran, never the steps before the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], *columns: str, step: int = 200) -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns, ``step`` rows at a time, so that a batch of long texts is never held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield tuple(part.column(c).to_pylist() for c in columns)


def frame(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def bit_map(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A map of fixed size (2 ** bits bits, in 64-bit words) that marks the ``key`` hashes of ``keys``."""
    place = F.pmod(F.col(key), F.lit(1 << bits))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("m")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.int64)
    marks[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return marks


def is_marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    places = keys.astype(np.int64) & (64 * len(marks) - 1)
    return (marks[places >> 6] >> (places & 63) & 1).astype(bool)


def only_marked(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a hash) is not in ``wanted``, so that they need no shuffle to the join.

    The marks are a bit map of fixed size (2 MB); more keys fill it and let more rows through, and lose none.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(bit_map(wanted, key, bits))

    @F.arrow_udf("boolean")
    def marked(keys: pa.Array) -> pa.Array:
        return pa.array(is_marked(shipped.value, keys.to_numpy(zero_copy_only=False)))

    return rows.where(marked(F.col(key)))


def text_rank(spark: SparkSession) -> int:
    """Partitions for a shuffle by our own keys."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(size, np.uint64)
            k = 1
            while k < size:
                out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Stretches:
    """Polynomial fingerprints of any stretch of an array of bytes or of 64-bit values, from prefix sums."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_BYTE[raw] if raw.dtype == np.uint8 else raw) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]
