"""Running plans side by side: time limits, cancellation, errors kept apart, answers as they come."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Outcome:
    """What became of a plan: its result, or a code and the error's text."""

    name: str
    value: object = None
    error_code: str | None = None
    message: str | None = None


def run_all(spark: SparkSession, plans: dict[str, Callable[[], object]], seconds: float | None = None) -> dict[str, Outcome]:
    """Run actions at once, each under a tag of its own. One that fails or is late leaves the others alone; a late one is stopped."""
    tags = {name: f"job-{uuid.uuid4().hex}" for name in plans}

    def one(name: str) -> object:
        spark.addTag(tags[name])
        try:
            return plans[name]()
        finally:
            spark.removeTag(tags[name])

    out = {}
    began = time.monotonic()
    pool = ThreadPoolExecutor(max(1, len(plans)))
    try:
        futures = {name: pool.submit(one, name) for name in plans}
        for name, future in futures.items():
            try:
                out[name] = Outcome(name, future.result(None if seconds is None else max(0.0, began + seconds - time.monotonic())))
            except Late:
                cancel(spark, tags[name])
                out[name] = Outcome(name, error_code="RETRIEVAL_TIMEOUT", message=f"not done after {seconds} s")
            except Exception as e:  # noqa: BLE001
                out[name] = Outcome(name, error_code="STRATEGY_FAILED", message=str(e))
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop all jobs under a tag."""
    spark.interruptTag(tag)


def stop(query: StreamingQuery, seconds: float = 30.0) -> bool:
    """End a stream after the batch that it is in; one that takes longer is interrupted. Whether the batch was let end."""
    began = time.monotonic()
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < began + seconds:
        time.sleep(0.05)
    whole = not query.isActive or not query.status["isTriggerActive"]
    query.stop()
    return whole


def answers(found: DataFrame, column: str = "answer", piece: int = 64) -> Iterator[tuple[object, int, str]]:
    """(query_id, number, text) pieces of answers as their partitions are done; the driver holds one partition at a time."""
    for row in found.select("query_id", column).toLocalIterator(prefetchPartitions=True):
        value = row[column] or ""
        for k, at in enumerate(range(0, len(value), piece)):
            yield row["query_id"], k, value[at : at + piece]
