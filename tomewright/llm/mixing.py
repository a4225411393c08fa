"""Mix sources to target weights, with DataFrame functions only.

The words of a source, its documents one after the other, are packed into blocks of fixed length. Every
output shard draws how many blocks of each source it holds; the draw is a multinomial one given the totals
that the targets fix (a free draw would miss them by the root of the count, and could take a document more
often than the cap allows). The slots of a source, numbered over all shards, pass through a pseudorandom
permutation of its block numbers for each epoch, and slots and blocks meet in a join by (source, block).

Defined results: null or blank texts have size 0 and are never taken; a null source is a source of its own,
last in order; rows that agree in id, source and text share what is taken of them as evenly as whole words
allow; an empty table gives an empty result; texts count whole at any length, a long one as many blocks; documents that
tie in order are such rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, text_rank

#: Sources up to this count are sent to every executor; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Output shards whose slots are numbered together.
SHARD_GROUP = 1024
ROUNDS = 24


@dataclass(frozen=True)
class MixPlan:
    """``documents``: a row per distinct (id, source, text) with its word span; ``slots``: a row per block that a shard holds."""

    sources: DataFrame
    n_sources: int
    documents: DataFrame
    slots: DataFrame
    block_words: int


def sized(small: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows, marked for broadcast where that is known to be small."""
    return F.broadcast(small) if n <= BROADCAST_SOURCES else small


def running(rows: DataFrame, of: Column, group: Column, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``of`` up to and with each row in the order of (group, order) within ``by``.

    Sums by group run first, then those within each group, so that no task has more than a group of a hot key.
    """
    rows = rows.withColumn("group", group).withColumn("part", of)
    sums = rows.groupBy(*by, "group").agg(F.sum("part").alias("whole"))
    before = F.coalesce(F.sum("whole").over(Window.partitionBy(*by).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*by, "group", before.alias("before"))
    inner = Window.partitionBy(*by, "group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("within", F.sum("part").over(inner)).join(offsets, [*by, "group"]).withColumn("upto", F.col("before") + F.col("within")).drop("group", "part", "within", "before")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float) -> list[float]:
    """Words wanted of each source: ``share`` of all words by weight, never above ``cap`` times the source's own."""
    left, open_ = share * sum(n for _, n in sizes), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        for i in open_:
            out[i] = left * weights[i % len(weights)] / total
        over = [i for i in open_ if out[i] > cap * sizes[i][1]]
        if not over:
            break
        for i in over:
            out[i] = float(cap * sizes[i][1])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permuted(x: Column, size: Column, seed: int, *key: Column) -> Column:
    """Swap-or-not shuffle: a keyed permutation of 0..size-1, evaluated at x."""

    def round_(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), *key, r), size) - at, size)
        high = F.greatest(at, partner)
        return F.when(F.xxhash64(F.lit(seed + 1), *key, r, high).bitwiseAND(F.lit(1)) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, round_)


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    shard_slots: int = 4096,
    bucket_docs: int = 4096,
    seed: int = 20240,
) -> MixPlan:
    """Plan the mix of ``docs`` (doc_id, text, source).

    The driver sees one row per source, nothing else: weights go round by the global order of the sources.
    """
    spark = docs.sparkSession
    base = materialize(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("digest"))
        .groupBy("doc_id", "source", "size", "digest")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    found = base.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([(r.source, r.words) for r in found], weights, share, cap)
    rows = []
    for i, (r, t) in enumerate(zip(found, wanted, strict=True)):
        blocks = -(-r.words // block_words)
        exact = t * blocks / r.words if r.words else 0.0
        full = min(int(exact + 1e-9), int(cap * blocks))
        last = int(round((exact - full) * block_words)) if full < cap * blocks else 0
        rows.append((i, r.source, r.words, float(t), blocks, full, max(0, last), -(-r.rows // bucket_docs)))
    sources = spark.createDataFrame(rows, "idx int, source string, source_size long, target double, blocks long, full_slots long, last_words long, buckets long")
    small = sized(sources, len(rows))

    # Word spans: sums by bucket, running over the buckets of a source, then running within each bucket.
    keyed = base.join(small, base["source"].eqNullSafe(sources["source"])).select(
        "idx", "doc_id", "size", "digest", "copies", F.pmod(F.xxhash64("doc_id", "digest"), "buckets").alias("bucket")
    )
    span = F.col("size") * F.col("copies")
    documents = running(keyed, span, F.col("bucket"), ["idx"], ["doc_id", "size", "digest"]).withColumn("start", F.col("upto") - span)

    # Slots: thrown at shards, counted, numbered per source over the shards, permuted.
    total = sum(r[5] for r in rows) + sum(1 for r in rows if r[6])
    shards = max(1, -(-total // shard_slots))
    plain = sources.select("idx", "blocks", "full_slots", "last_words", (F.col("full_slots") + (F.col("last_words") > 0).cast("long")).alias("slots"))
    # Few rows before the explode stand for many after it, so their partitions are counted and not sized.
    chunk, parts = 1 << 14, text_rank(spark)
    thrown = (
        plain.where("slots > 0")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {chunk}"))).alias("chunk"))
        .repartition(parts, "idx", "chunk")
        .select("*", F.explode(F.expr(f"sequence(chunk * {chunk}, least(slots, (chunk + 1) * {chunk}) - 1)")).alias("t"))
        .groupBy("idx", "blocks", "full_slots", "last_words", F.pmod(F.xxhash64(F.lit(seed), "idx", "t"), F.lit(shards)).alias("shard"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    numbered = running(thrown, F.col("n"), F.expr(f"shard div {SHARD_GROUP}"), ["idx"], ["shard"])
    slots = (
        numbered.withColumn("first", F.col("upto") - F.col("n"))
        .repartition(parts, "idx", "shard")
        .withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
        .withColumn("epoch", F.expr("slot div blocks"))
        .select(
            "shard",
            "idx",
            "slot",
            permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), seed, F.col("idx"), F.col("epoch")).alias("block"),
            F.when(F.col("slot") < F.col("full_slots"), F.lit(block_words).cast("long")).otherwise(F.col("last_words")).alias("words"),
        )
    )
    return MixPlan(sources, len(rows), documents, slots, block_words)


def taken(plan: MixPlan) -> DataFrame:
    """A row per row of the mixed table: idx, doc_id, digest, size, taken."""
    length = plan.block_words
    # Slots of a block that take as many words of it meet before the shuffle to the documents.
    uses = plan.slots.groupBy("idx", "block", "words").agg(F.count(F.lit(1)).alias("uses"))
    pieces = plan.documents.select(
        "idx", "doc_id", "digest", "size", "copies", "start",
        F.explode_outer(F.expr(f"IF(size > 0, sequence(start div {length}, (start + size * copies - 1) div {length}), NULL)")).alias("block"),
    )
    low = F.greatest("start", F.col("block") * length)
    high = F.least(F.col("start") + F.col("size") * F.col("copies"), F.col("block") * length + F.col("words"))
    sums = (
        pieces.join(uses.hint("merge"), ["idx", "block"], "left")
        .groupBy("idx", "doc_id", "digest", "size", "copies", "start")
        .agg(F.coalesce(F.sum(F.greatest(high - low, F.lit(0)) * F.col("uses")), F.lit(0)).alias("all_taken"))
    )
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        "idx", "doc_id", "digest", "size", F.expr("all_taken div copies + IF(copy < all_taken % copies, 1L, 0L)").alias("taken")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken."""
    plan = plan_mix(docs, **options)
    small = plan.sources.select("idx", "source", "source_size", "target")
    return taken(plan).join(sized(small, plan.n_sources), "idx").select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: int = 20240, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes its words over, whole.

    A fraction of a document rounds up with its own probability, by a hash of the id, so the words of a
    source stay at their target on average. A document without words stays once.
    """
    plan = plan_mix(docs, seed=seed, **options)
    whole = taken(plan).groupBy("idx", "doc_id", "digest").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("copies"))
    chance = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "digest"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    doc, digest, source, times, row = fresh(docs, "doc", "digest", "source_of", "times", "row")
    often = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / (F.col("size") * F.col("copies")) + chance)).cast("int")
    small = sized(plan.sources.select("idx", F.col("source").alias(source)), plan.n_sources)
    wanted = whole.join(small, "idx").select(F.col("doc_id").alias(doc), F.col("digest").alias(digest), source, often.alias(times)).where(F.col(times) > 0)
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(digest)) & F.col("source").eqNullSafe(F.col(source))
    met = docs.withColumn(row, F.xxhash64("text")).join(wanted, on)
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
