"""A Merkle manifest of a dataset: trees per source under one root, inclusion proofs, and verification.

Leaves are digests of rows, made by built-in functions before anything is shuffled, so texts stay where they are and
only digests move. Leaves get their place in their source by a sort over ranges and counts per range (``placed``).
A block of WIDTH nodes is a whole subtree of LEVELS levels; blocks are the unit of work: an executor holds whole
blocks as Arrow tables, aligned to multiples of WIDTH, and DuckDB makes their levels, each one an ordered
``string_agg`` and a ``sha256`` per run of sixteen. The roots of blocks are the nodes of the next stage, and so on until
each source has one; the roots of sources go the same way to the one root. Proofs come back down: a block is given the
proof of its own root, in one row of its own, and DuckDB puts the block's levels before it.

No step depends on the size of a source: one that holds a third of all rows has more blocks, not larger ones.

Defined results: a null is ``-`` in its row's leaf, and a null source is the first one; null ids come first in their
source and are never tampered with; rows that repeat an id are leaves of their own, ordered by their digest; a
source of one row is its leaf; a dataset of one source has its subroot as root; an empty table gives an empty
result; texts are read whole at any length; of other columns no notice is taken.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frame, materialize

#: Nodes that become one.
FAN = 16
LEVELS = 3
#: Nodes of a block.
WIDTH = FAN**LEVELS
#: Rows handed to DuckDB at once, in whole blocks.
ROWS = 2 * WIDTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its value, or ``-``."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]).cast("binary"), 256)


def placed(nodes: DataFrame, key: str, *order: str) -> DataFrame:
    """``nodes`` with their place (pos, from 0) in the order of their ``key``, and how many that has (n); written.

    Rows are sorted by ranges; counts per range and key, added up in the order of ranges, are all that is windowed.
    """
    sorted_ = materialize(nodes.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = sorted_.withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_here"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_here").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(key, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_here").over(Window.partitionBy(key)).alias("n"))
    return materialize(ranged.join(shifts, [key, "_range"]).select(*nodes.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n"))


def _levels(h: str = "h") -> str:
    """SQL of a block's levels: r1 to r3 with their runs' digests strung together (x) and the node that they become (h)."""
    made = []
    below, node, place = "t", h, "pos"
    for j in range(1, LEVELS + 1):
        made.append(
            f"r{j} AS (SELECT key, bucket, {place} // {FAN} AS p{j}, any_value(n) AS n, string_agg({node}, '' ORDER BY {place}) AS x{j},"
            f" CASE WHEN any_value(n) > {FAN ** (j - 1)} THEN sha256(string_agg({node}, '' ORDER BY {place})) ELSE any_value({node}) END AS h{j} FROM {below} GROUP BY key, bucket, {place} // {FAN})"
        )
        below, node, place = f"r{j}", f"h{j}", f"p{j}"
    return ", ".join(made)


#: The root of each block, as the next stage's node.
UP = f"WITH {_levels()} SELECT key, bucket AS pos, CAST(ceil(n / {WIDTH}) AS BIGINT) AS n, h{LEVELS} AS h FROM r{LEVELS}"


def _sides(side: str) -> str:
    """SQL of the list of what stands left (or right) of a node's way up, level by level to the root."""
    own = []
    for j, place in enumerate(("t.pos", "p1", "p2"), 1):
        i = f"CAST({place} % {FAN} AS BIGINT)"
        own.append(f"substr(x{j}, 1, 64 * {i})" if side == "left" else f"substr(x{j}, 64 * {i} + 65)")
    cases = " ".join(f"WHEN t.n > {FAN ** (j - 1)} THEN [{', '.join(own[:j])}]" for j in range(LEVELS, 0, -1))
    return f"list_concat(CASE {cases} ELSE [] END, o.{side}_)"


#: Each node of a block with its way up; o has the way up of each block.
DOWN = f"""WITH {_levels()}
SELECT t.id, t.pos, t.key, t.h, coalesce(t.f, t.h) AS f, {_sides('left')} AS left_, {_sides('right')} AS right_, o.subroot, o.root
FROM t JOIN r1 ON r1.key = t.key AND r1.bucket = t.bucket AND p1 = t.pos // {FAN} JOIN r2 ON r2.key = t.key AND r2.bucket = t.bucket AND p2 = p1 // {FAN} JOIN r3 ON r3.key = t.key AND r3.bucket = t.bucket AND p3 = p2 // {FAN}
  JOIN o ON o.key = t.key AND o.bucket = t.bucket"""


def _folded(depth: int) -> str:
    """SQL that goes up the way from the tampered digest (f) and strings all siblings together."""
    rows = f"({DOWN})"
    for k in range(1, depth + 1):
        rows = f"(SELECT * REPLACE (CASE WHEN len(left_) >= {k} THEN sha256(left_[{k}] || f || right_[{k}]) ELSE f END AS f) FROM {rows})"
    return f"SELECT id, h, subroot, root, sha256(array_to_string(list_transform(range(1, len(left_) + 1), lambda i: left_[i] || right_[i]), '')) AS proof, f FROM {rows}"


NODE = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())])
WAY = pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("left_", pa.list_(pa.string())), ("right_", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
WAY_DDL = "key string, bucket long, left_ array<string>, right_ array<string>, subroot string, root string"
PROOF = pa.schema([("id", pa.int64()), ("h", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.string()), ("f", pa.string())])


def _engine():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Whole blocks, about ``rows`` rows at once; from rows in the order of key and bucket."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = pa.table(batch.slice(at, rows))
            held.append(some)
            size += some.num_rows
            if size >= rows:
                table = pa.concat_tables(held).combine_chunks()
                last = {c: table.column(c)[-1] for c in ("key", "bucket")}
                keys, buckets = table.column("key").to_pylist(), table.column("bucket").to_pylist()
                whole = table.num_rows - 1
                while whole >= 0 and keys[whole] == last["key"].as_py() and buckets[whole] == last["bucket"].as_py():
                    whole -= 1
                whole += 1
                if whole:
                    yield table.slice(0, whole)
                held = [table.slice(whole)]
                size = table.num_rows - whole
    if held and size:
        yield pa.concat_tables(held).combine_chunks()


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "pos")


def _said(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in table.select(schema.names).cast(schema).to_batches():
        yield frame(schema, *batch.columns)


def block_roots(nodes: DataFrame) -> DataFrame:
    """(key, pos, n, h) of the next stage; from such rows of one stage, with pos from 0 without gaps per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine()
        for t in _blocks(batches):
            engine.register("t", t)
            yield from _said(engine.execute(UP).to_arrow_table(), NODE)
            engine.unregister("t")

    blocked = nodes.select("key", F.expr(f"pos div {WIDTH}").alias("bucket"), "pos", "n", "h")
    return _dealt(blocked).mapInArrow(run, "key string, pos long, n long, h string")


def _down(nodes: DataFrame, ways: DataFrame, last: bool) -> DataFrame:
    """Ways of ``nodes``, from those of their blocks; of the ``last`` ones the proofs and the folded roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine()
        for both in _blocks(batches):
            way = both.filter(pc.equal(both.column("pos"), -1))
            engine.register("t", both.filter(pc.greater_equal(both.column("pos"), 0)).drop_columns(["left_", "right_", "subroot", "root"]))
            engine.register("o", way.select(WAY.names))
            if last:
                depth = LEVELS + max((len(x) for x in way.column("left_").to_pylist()), default=0)
                yield from _said(engine.execute(_folded(depth)).to_arrow_table(), PROOF)
            else:
                found = engine.execute(f"SELECT key, pos AS bucket, left_, right_, coalesce(subroot, h) AS subroot, root FROM ({DOWN})").to_arrow_table()
                yield from _said(found, WAY)
            engine.unregister("t")
            engine.unregister("o")

    none = F.lit(None)
    text = none.cast("string")
    rows = nodes.select("key", F.expr(f"pos div {WIDTH}").alias("bucket"), "pos", "n", "h", F.col("f") if last else text.alias("f"), F.col("id") if last else none.cast("long").alias("id"), *[none.cast("array<string>").alias(c) for c in ("left_", "right_")], text.alias("subroot"), text.alias("root"))
    # One row more per block has the block's way, before its nodes; so the way is not repeated with each node.
    heads = ways.select("key", "bucket", F.lit(-1).cast("long").alias("pos"), none.cast("long").alias("n"), text.alias("h"), text.alias("f"), none.cast("long").alias("id"), "left_", "right_", "subroot", "root")
    out = "id long, h string, subroot string, root string, proof string, f string" if last else WAY_DDL
    return _dealt(rows.unionByName(heads)).mapInArrow(run, out)


def stages(leaves: DataFrame) -> list[DataFrame]:
    """The written nodes of each stage, from leaves (key, pos, n, h) to one node per key. A stage is WIDTH times smaller than the one before."""
    out = [leaves]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(materialize(block_roots(out[-1])))
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: its ``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` gives values that replace fields ``where`` it holds; the root folded from the leaf so made, along the
    proof of the leaf as it was, shows it.
    """
    changed = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in fields]
    key = F.when(F.col(by).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(by).cast("string")))
    own = leaf(*[F.col(f"`{c}`") for c in fields])
    other = F.when(F.coalesce(where, F.lit(False)), leaf(*changed)) if tampered and where is not None else F.lit(None).cast("string")
    leaves = placed(docs.select(key.alias("key"), F.col(order).cast("long").alias("id"), own.alias("h"), other.alias("f")), "key", "id", "h")
    inner = stages(leaves)
    subroots = inner[-1].select("key", "h")
    outer = stages(placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "h"), "key", "name"))
    ways = outer[-1].select("key", F.lit(0).cast("long").alias("bucket"), F.array().cast("array<string>").alias("left_"), F.array().cast("array<string>").alias("right_"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    for nodes in reversed(outer[:-1] or outer):
        ways = materialize(_down(nodes, ways, last=False))
        # A subroot is the node itself at the first stage of the outer tree only.
        ways = ways.withColumn("subroot", F.lit(None).cast("string")) if nodes is not outer[0] else ways
    ways = ways.join(outer[0].select(F.col("pos").alias("bucket"), "name"), "bucket").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("bucket"), "left_", "right_", "subroot", "root")
    for nodes in reversed(inner[1:-1]):
        ways = materialize(_down(nodes, ways, last=False))
    found = _down(inner[0], ways, last=True)
    return found.select(F.col("id").alias(order), F.col("h").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("f").alias("folded_root"), (F.col("f") == F.col("root")).alias("verified"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
