"""Domain events: an append-only table, subscriptions by event or ancestor type, isolated handlers, windows."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id string, occurred_at timestamp, event_type string, document_id string, payload string"
#: Event types in the order of an ingestion, and what they are kinds of.
TYPES = ("DocumentUploaded", "DocumentParsed", "DocumentChunked", "EmbeddingsGenerated", "VectorsIndexed", "IngestionCompleted", "IngestionFailed")
BASE = "DomainEvent"


def ancestors(spark: SparkSession, parents: dict[str, str] | None = None) -> DataFrame:
    """(event_type, ancestor): each type with itself and all that it is a kind of. As small as the type system."""
    of = dict.fromkeys(TYPES, BASE) if parents is None else parents
    rows = []
    for t in dict.fromkeys((*of, *of.values())):
        at: str | None = t
        while at is not None:
            rows.append((t, at))
            at = of.get(at)
    return spark.createDataFrame(rows, "event_type string, ancestor string")


def fan_out(events: DataFrame, subscriptions: DataFrame, kinds: DataFrame) -> DataFrame:
    """A row per event and handler (handler, subscribed_type) whose type is the event's or an ancestor, each handler once."""
    matched = kinds.join(subscriptions.dropDuplicates(), kinds["ancestor"] == subscriptions["subscribed_type"]).select("event_type", "handler").distinct()
    return events.join(matched, "event_type")


class Dispatcher:
    """Handlers over micro-batches; one that fails is logged and leaves the others alone."""

    def __init__(self) -> None:
        self.handlers: list[tuple[str, Callable[[DataFrame], None]]] = []
        self.errors: list[tuple[str, str]] = []

    def subscribe(self, event_type: str, handler: Callable[[DataFrame], None]) -> None:
        if (event_type, handler) not in self.handlers:
            self.handlers.append((event_type, handler))

    def unsubscribe(self, event_type: str, handler: Callable[[DataFrame], None]) -> None:
        if (event_type, handler) in self.handlers:
            self.handlers.remove((event_type, handler))

    def publish(self, batch: DataFrame) -> None:
        for event_type, handler in list(self.handlers):
            try:
                handler(batch if event_type == BASE else batch.where(F.col("event_type") == event_type))
            except Exception as e:  # noqa: BLE001 - a handler's fault must not stop the others
                self.errors.append((event_type, str(e)))
                logging.getLogger(__name__).warning("handler of %s failed: %s", event_type, e)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda batch, _: self.publish(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream(spark: SparkSession, path: str, schema: str = EVENT, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "1 hour", time: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per window; on a stream, rows later than the watermark are left out. An extension."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("sum_value")).select(F.col("w.start").alias("window_start"), *by, "n_events", "sum_value")


def sliding(events: DataFrame, width: str = "2 hours", every: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, every).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), "n_events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def deduplicated(events: DataFrame, late: str = "1 hour", time: str = "occurred_at") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])


def unprocessed(items: DataFrame, done: DataFrame, key: str = "checksum") -> DataFrame:
    """What a resumed job still has to do."""
    return items.join(done.select(key), key, "left_anti")
