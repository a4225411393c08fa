"""Schedules as a table: entries, due runs, cancellation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import known_frequency, next_run


def schedule(jobs: DataFrame, now: Column) -> DataFrame:
    """Entries of (job_id, frequency, cron_expression): unknown frequencies are custom; cron text is kept, not read."""
    frequency = known_frequency(F.col("frequency"))
    return jobs.select(
        F.sha2(F.concat_ws(":", F.col("job_id"), frequency).cast("binary"), 256).alias("schedule_id"),
        "job_id",
        frequency.alias("frequency"),
        F.lit(True).alias("is_active"),
        "cron_expression",
        now.alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_run_at"),
        next_run(frequency, now).alias("next_run_at"),
    )


def due(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("is_active") & (F.col("next_run_at") <= now))


def ran(entries: DataFrame, now: Column) -> DataFrame:
    hit = F.col("is_active") & F.coalesce(F.col("next_run_at") <= now, F.lit(False))
    return entries.withColumn("last_run_at", F.when(hit, now).otherwise(F.col("last_run_at"))).withColumn("next_run_at", F.when(hit, next_run(F.col("frequency"), now)).otherwise(F.col("next_run_at")))


def cancel(entries: DataFrame, schedule_id: str) -> DataFrame:
    return entries.withColumn("is_active", F.col("is_active") & (F.col("schedule_id") != schedule_id))


def active(entries: DataFrame) -> DataFrame:
    return entries.where("is_active")
