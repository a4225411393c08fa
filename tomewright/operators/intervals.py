"""Joins of points with the intervals that hold them, by bins of a width that fits each interval.

An interval belongs to the level whose bins are as wide as itself, rounded up to a power of two of the least width, and
so lies in two of that level's bins at most; a point lies in one bin of each level that there is. So both sides meet in
an equi-join on level and bin, each pair once, and neither a broadcast nor a nested loop is needed. Bins that hold
more points than ``heavy`` are split: their points are dealt to parts by a hash, their intervals go to all parts.

``interval_totals`` gives sums over what each interval holds without its pairs, whose number grows with both sides at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, TimestampNTZType, TimestampType

#: Distinct places of points that one task holds at once, and intervals that meet them in one task.
RANGE, PIECES = 50_000, 1_000_000


def _number(c: Column, kind: DataType) -> Column:
    """Values as doubles; times in seconds."""
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return c.cast("double")


def least_width(intervals: DataFrame, low: str, high: str) -> float:
    """The width of the bins of the first level: a tenth of the intervals are shorter."""
    span = _number(F.col(high), intervals.schema[high].dataType) - _number(F.col(low), intervals.schema[low].dataType)
    return intervals.where(span > 0).agg(F.percentile_approx(span, 0.1)).first()[0] or 1.0


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float | None = None, heavy: int = 100_000) -> DataFrame:
    """Rows of ``points`` with rows of ``intervals`` such that low <= at < high. A null, or an interval without extent, meets nothing."""
    width = width or least_width(intervals, low, high)
    if width <= 0:
        raise ValueError("bins need a positive width")
    a, b = (_number(F.col(c), intervals.schema[c].dataType) for c in (low, high))
    level = F.greatest(F.lit(0), F.ceil(F.log2((b - a) / width))).cast("int")
    sized = intervals.where(F.col(low) < F.col(high)).withColumn("_level", level)
    wide = F.lit(float(width)) * F.pow(F.lit(2.0), "_level")
    dealt = sized.withColumn("_bin", F.explode(F.sequence(F.floor(a / wide), F.floor(b / wide))))
    # As many levels as widths differ in powers of two.
    levels = sorted(r["_level"] for r in sized.select("_level").distinct().collect())
    if not levels:
        return points.join(intervals, F.lit(False))
    p = _number(F.col(at), points.schema[at].dataType)
    placed = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bin", F.floor(p / wide))
    counts = placed.groupBy("_level", "_bin").agg(F.ceil(F.count(F.lit(1)) / heavy).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    on = ["_level", "_bin"]
    own = placed.join(counts, on, "left").withColumn("_part", F.pmod(F.xxhash64(*[c for c in points.columns if "map<" not in points.schema[c].dataType.simpleString()]), parts).cast("int")).drop("_parts")
    every = dealt.join(counts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    left, right = own.alias("p"), every.alias("i")
    met = left.join(right, [F.col(f"p.{c}") == F.col(f"i.{c}") for c in (*on, "_part")] + [F.col(f"p.{at}") >= F.col(f"i.{low}"), F.col(f"p.{at}") < F.col(f"i.{high}")])
    return met.select(*[F.col(f"p.`{c}`") for c in points.columns], *[F.col(f"i.`{c}`") for c in intervals.columns])


def _places(kinds: list[DataType], columns: list[Column]) -> list[Column]:
    """Columns on one scale: microseconds or whole numbers where all of them are such, else doubles."""
    times = [isinstance(k, (TimestampType, TimestampNTZType, DateType)) for k in kinds]
    if all(times):
        return [F.unix_micros(c.cast("timestamp")) for c in columns]
    return [c.cast("long" if all(isinstance(k, IntegralType) for k in kinds) else "double") for c in columns]


class _Totals:
    """Count, sum and least value over any stretch of points in order, from the nodes of a binary tree."""

    #: Name, type, value of nothing, how two are joined.
    KINDS = (("n", np.int64, 0, np.add), ("total", np.float64, 0, np.add), ("n_total", np.int64, 0, np.add), ("first", np.int64, np.iinfo(np.int64).max, np.minimum), ("n_first", np.int64, 0, np.add))
    NAMES = [k[0] for k in KINDS]

    def __init__(self, columns: list[np.ndarray]) -> None:
        self.size = 1 << max(0, len(columns[0]) - 1).bit_length()
        self.nodes = []
        for own, (_, kind, none, join) in zip(columns, self.KINDS, strict=True):
            tree = np.full(2 * self.size, none, kind)
            tree[self.size : self.size + len(own)] = own
            low = self.size
            while low > 1:
                tree[low // 2 : low] = join(tree[low : 2 * low : 2], tree[low + 1 : 2 * low : 2])
                low //= 2
            self.nodes.append(tree)

    def of(self, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Those of the points low <= place < high."""
        out = [np.full(len(low), none, kind) for _, kind, none, _ in self.KINDS]
        low, high = low + self.size, high + self.size
        while (some := low < high).any():
            left, right = np.flatnonzero(some & (low & 1 == 1)), np.flatnonzero(some & (high & 1 == 1))
            high[right] -= 1
            for rows, at in ((left, low[left]), (right, high[right])):
                for o, tree, (_, _, _, join) in zip(out, self.nodes, self.KINDS, strict=True):
                    o[rows] = join(o[rows], tree[at])
            low[left] += 1
            low, high = low >> 1, high >> 1
        return out

    @classmethod
    def joined(cls, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [join(x, y) for x, y, (_, _, _, join) in zip(a, b, cls.KINDS, strict=True)]


def _columns(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    return [table.column(name).fill_null(none).to_numpy() for name, _, none, _ in _Totals.KINDS]


def interval_totals(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, value: str, first: str, size: int = RANGE, heavy: int = PIECES) -> DataFrame:
    """(key, n, total, first): of the points low <= at < high of each interval the count, the sum of ``value`` and the least (whole) number ``first``.

    Points of one place are added up first. Their places are cut into ranges of about ``size``; an interval goes to the
    ranges of its two ends, where a tree over the range's points gives its share, and what lies between are totals of
    whole ranges. So the work follows points and intervals, not their pairs. Ranges that more than ``heavy`` intervals
    go to are split by intervals. Intervals of one key are one; a key without points is left out, as are nulls.
    """
    kinds = [points.schema[at].dataType, *[intervals.schema[c].dataType for c in (low, high)]]
    place, a, b = _places(kinds, [F.col(at), F.col(low), F.col(high)])
    scale = "long" if isinstance(kinds[0], (TimestampType, TimestampNTZType, DateType)) or all(isinstance(k, IntegralType) for k in kinds) else "double"
    sums = [F.sum(F.col(c)).alias(c) if c != "first" else F.min("first").alias("first") for c in _Totals.NAMES]
    single = points.where(F.col(at).isNotNull()).select(place.alias("a"), F.lit(1).cast("long").alias("n"), F.col(value).cast("double").alias("total"), F.col(value).isNotNull().cast("long").alias("n_total"), F.col(first).cast("long").alias("first"), F.col(first).isNotNull().cast("long").alias("n_first"))
    grouped = single.groupBy("a").agg(*sums)
    parts = -(-grouped.count() // size)
    cuts = np.array([])
    if parts > 1:
        cuts = np.unique(grouped.agg(F.percentile_approx("a", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(max(10_000, 20 * parts)))).first()[0])

    @F.arrow_udf("int")
    def range_of(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, values.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    ranged = grouped.withColumn("range", range_of(F.col("a")))
    whole = {r.range: r for r in ranged.groupBy("range").agg(*sums).collect()}
    between = _Totals([np.array([none if r not in whole or whole[r][name] is None else whole[r][name] for r in range(len(cuts) + 1)], kind) for name, kind, none, _ in _Totals.KINDS])
    sized = intervals.where((F.col(low) < F.col(high)) & F.col(key).isNotNull()).select(F.col(key).alias("key"), a.alias("a"), b.alias("b"))
    ends = sized.withColumn("range", range_of(F.col("a"))).withColumn("until", range_of(F.col("b")))
    pieces = ends.select("key", "a", "b", "until", F.explode(F.array_distinct(F.array("range", "until"))).alias("range"))
    many = np.ones(len(cuts) + 1, np.int64)
    for r in pieces.groupBy("range").count().where(F.col("count") > heavy).collect():
        many[r["range"]] = -(-r["count"] // heavy)

    @F.arrow_udf("int")
    def parts_of(ranges: pa.Array) -> pa.Array:
        return pa.array(many[ranges.to_numpy(zero_copy_only=False)], pa.int32())

    every = ranged.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of(F.col("range")) - 1))).withColumn("kind", F.lit(0))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("key", "a", "b"), parts_of(F.col("range"))).cast("int")).withColumn("kind", F.lit(1))
    key_type = intervals.schema[key].dataType.simpleString()
    ddl = f"key {key_type}, n long, total double, n_total long, first long, n_first long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, places, now = [], None, np.array([]), None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("range", "part", "kind")])
            edges = [0, *(np.flatnonzero((np.diff(group) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if begin == end:
                    continue
                some = batch.slice(begin, end - begin)
                of, _, kind = mine = group[:, begin].tolist()
                if mine[:2] != now:
                    held, tree, now = [], None, mine[:2]
                if kind == 0:
                    held.append(some)
                    continue
                if tree is None:
                    own = pa.Table.from_batches(held) if held else some.slice(0, 0)
                    places, tree, held = own.column("a").to_numpy(), _Totals(_columns(own)), []
                at_low, at_high = (np.searchsorted(places, some.column(c).to_numpy()) for c in ("a", "b"))
                until = some.column("until").to_numpy().astype(np.int64)
                found = _Totals.joined(tree.of(at_low, at_high), between.of(np.full(len(until), of + 1), np.where(until > of, until, of + 1)))
                yield pa.RecordBatch.from_arrays([some.column("key"), *[pa.array(f) for f in found]], names=["key", *_Totals.NAMES])

    columns = ["range", "part", "kind", "a", "b", "until", "key", *_Totals.NAMES]
    none = {"b": scale, "until": "int", "key": key_type, "n": "long", "total": "double", "n_total": "long", "first": "long", "n_first": "long"}
    both = [side.select(*[F.col(c) if c in side.columns else F.lit(None).cast(none[c]).alias(c) for c in columns]) for side in (every, dealt)]
    met = both[0].unionByName(both[1]).repartition("range", "part").sortWithinPartitions("range", "part", "kind", "a").mapInArrow(run, ddl)
    found = met.groupBy("key").agg(*sums).where("n > 0")
    return found.select(F.col("key").alias(key), "n", F.when(F.col("n_total") > 0, F.col("total")).alias("total"), F.when(F.col("n_first") > 0, F.col("first")).alias("first"))
