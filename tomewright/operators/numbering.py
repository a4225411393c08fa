"""Row numbers within groups of any size: a sort over ranges, counts per range and group, and no window over a group's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import shared_folder


def numbered(df: DataFrame, group: list[str], order: list[str], into: str = "row_number") -> DataFrame:
    """``df`` with the place of each row in its group, from 0, by ``order``; a group of a third of all rows has many tasks.

    The sorted rows are checkpointed in the shared folder, so that numbers and counts are of the same ranges whatever is
    computed again; a window then sees a row per range and group only. Rows that tie are numbered in some order.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    keys = [*group, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).checkpoint().withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_here"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_here").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_r"), (before - F.col("_first")).alias("_shift"))
    same = [rows[g].eqNullSafe(shifts[f"_{g}"]) for g in group] + [rows["_range"] == shifts["_r"]]
    return rows.join(shifts, same).select(*[rows[c] for c in df.columns], (F.col("_at") + F.col("_shift")).alias(into))
