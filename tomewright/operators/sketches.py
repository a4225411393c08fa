"""Counts of distinct values and quantiles from stored sketches, made once per day and merged to any coarser group.

A day's sketch is a column of a few kilobytes, so a month or a year is answered from days, without the rows again, and
new days are added beside the old ones. HyperLogLog counts within about 1.04 / 2 ** (bits / 2); KLL quantiles are within
a rank error of about 1.65 / k ** 0.97.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
K = 200


def daily(rows: DataFrame, at: str, by: list[str], counted: str, measured: str, bits: int = BITS, k: int = K) -> DataFrame:
    """(day, by..., n, distinct_sketch, value_sketch) per day and group."""
    return rows.groupBy(F.to_date(at).alias("day"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.xxhash64(counted), F.lit(bits)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(k)).alias("value_sketch")
    )


def merged(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches of coarser groups, of the same form, from those of finer ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimates(sketches: DataFrame, *quantiles: float) -> DataFrame:
    """The sketches' groups with ``distinct_estimate`` and one column per quantile (q50 for 0.5), without the sketches."""
    read = [F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    keep = [c for c in sketches.columns if c not in ("distinct_sketch", "value_sketch")]
    return sketches.select(*keep, F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"), *read)


def distinct_error(bits: int = BITS) -> float:
    """Relative standard error of a count."""
    return 1.04 / 2 ** (bits / 2)


def rank_error(k: int = K) -> float:
    """Error of a quantile's rank at about 99 in 100, for one group of any number of merged sketches."""
    return 2.446 / k**0.9433
