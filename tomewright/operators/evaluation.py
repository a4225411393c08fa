"""Retrieval and generation metrics, and the tables that compare runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: precision, recall, reciprocal rank, nDCG and hit at ``k``.

    ``results``: (query_id, id, rank); ``relevant``: (query_id, id). Queries without results count as misses.
    """
    truth = relevant.select("query_id", "id").distinct()
    hits = results.where(F.col("rank") <= k).join(truth.withColumn("rel", F.lit(1)), ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    per_query = hits.groupBy("query_id").agg(
        F.sum("rel").alias("found"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    wanted = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return wanted.join(per_query, "query_id", "left").select(
        "query_id",
        F.round(F.coalesce(F.col("found"), F.lit(0)) / k, 6).alias("precision"),
        F.round(F.coalesce(F.col("found"), F.lit(0)) / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
        F.when(F.coalesce(F.col("found"), F.lit(0)) > 0, 1).otherwise(0).alias("hit"),
    )


def token_f1(answer: Column, reference: Column) -> Column:
    """Harmonic mean of precision and recall over distinct tokens."""
    a, b = (F.array_distinct(text.query_tokens(c, 1 << 30)) for c in (answer, reference))
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, F.lit(0.0)).otherwise(F.round(2 * common / (F.size(a) + F.size(b)), 6))


def citation_scores(cited: Column, relevant: Column) -> Column:
    common = F.size(F.array_intersect(cited, relevant))
    return F.struct(F.coalesce(F.try_divide(common, F.size(cited)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(common, F.size(relevant)), F.lit(0.0)).alias("recall"))


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of the answer's distinct tokens that its contexts hold."""
    words = F.array_distinct(text.query_tokens(answer, 1 << 30))
    held = F.array_distinct(text.query_tokens(F.array_join(contexts, " "), 1 << 30))
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(words, held)), F.size(words)), 6), F.lit(0.0))


def overall(frame: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """A row per metric with its mean, least, most, deviation and median."""
    long = frame.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("deviation"), F.round(F.percentile("value", 0.5), 6).alias("median")
    )


def leaderboard(scores: DataFrame, model: str, metric: str) -> DataFrame:
    board = scores.groupBy(model).agg(F.round(F.avg(metric), 6).alias("mean_score"), F.count(F.lit(1)).alias("n_runs"))
    # One row per model: the order over all of them is the report.
    return board.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("mean_score"))))


def compare_providers(scores: DataFrame, row: str, provider: str, metric: str, providers: list[str]) -> DataFrame:
    return scores.groupBy(row).pivot(provider, providers).agg(F.round(F.avg(metric), 6))


def compare_runs(base: DataFrame, new: DataFrame, key: str, metric: str) -> DataFrame:
    """Full outer join on the question: both values, their difference and a verdict."""
    a, b = base.select(key, F.col(metric).alias("base_value")), new.select(key, F.col(metric).alias("new_value"))
    change = F.round(F.col("new_value") - F.col("base_value"), 6)
    verdict = F.when(F.col("base_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(change > 0, "better").when(change < 0, "worse").otherwise("same")
    return a.join(b, key, "full_outer").select(key, "base_value", "new_value", change.alias("change"), verdict.alias("verdict"))


def failures(frame: DataFrame, metric: str, below: float, *by: str) -> DataFrame:
    return frame.where(F.coalesce(F.col(metric) < below, F.lit(True))).groupBy(*by).agg(F.count(F.lit(1)).alias("n_failures"), F.round(F.avg(metric), 6).alias("mean_score"))
