"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a shuffle by node; the table is written to the shared folder after each round, so neither links
nor components ever reach the driver, and a lost executor repeats one step. A node that is linked to very many
others keeps its neighbours in rows: the minimum per node is an aggregate with map-side combination, joined
back, never a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges (a, b): each node links its larger (or its smaller) neighbours to the least one around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b longs), component being the least node reachable."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        before, now = now, materialize(_star(_star(now, large=True), large=False))
        discard(before)
        # A star forest stays as it is under both steps; counts and sums of its edges are then the same twice.
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
