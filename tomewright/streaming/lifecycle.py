"""Runs of a document through its ingestion, as a state machine over events: in a batch by windows, on a stream by keyed state.

A run begins with any event of a key that has no open run, ends with an event that completes or fails it, and fails by
timeout where the next event comes later than that after the last one. ``runs`` tells this from a table with window
functions. ``stream_runs`` keeps state per key instead: events that arrive out of order are held until the watermark has
passed them, are then applied in the order of time and id, and timers end the runs that nothing continues. Both give the
same rows, the stream those that the watermark has passed. Events later than the watermark are left out there.

An extension: the platform this engine serves has the events, but no state over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import TYPES


@dataclass(frozen=True)
class Machine:
    """Event types in the order of their stages, those that end a run, and how long a run may rest."""

    stages: tuple[str, ...] = TYPES[:-1]
    completes: tuple[str, ...] = ("IngestionCompleted",)
    fails: tuple[str, ...] = ("IngestionFailed",)
    timeout_seconds: int = 3600

    def place(self, event_type: str) -> int:
        return self.stages.index(event_type) + 1 if event_type in self.stages else 0

    def status(self, event_type: str) -> str | None:
        return "completed" if event_type in self.completes else "failed" if event_type in self.fails else None

    def place_of(self, c: Column) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(self.stages) for x in (F.lit(s), F.lit(i + 1))]), c), F.lit(0))


def runs(events: DataFrame, machine: Machine, key: str, at: str, event_id: str, event_type: str) -> DataFrame:
    """(key, run_start, run_end, n_events, reached, n_back, status) per run of a table of events.

    ``reached`` is the furthest stage, ``n_back`` counts events of a stage before that of the event ahead of them.
    A run that nothing ends has timed out.
    """
    kind_of_time = events.schema[at].dataType
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at, event_id)
    ends = F.col(event_type).isin(*machine.completes, *machine.fails)
    rested = F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w) > machine.timeout_seconds * 1_000_000
    first = F.lag(at).over(w).isNull() | rested | F.lag(ends).over(w)
    numbered = events.select(F.col(key).alias(key), F.col(at).alias("at"), F.col(event_id).alias("event_id"), F.col(event_type).alias("event_type"), machine.place_of(F.col(event_type)).alias("place"), F.sum(first.cast("int")).over(w).alias("run"))
    back = F.lag("place").over(Window.partitionBy(key, "run").orderBy("at", "event_id")) > F.col("place")
    last = F.max_by("event_type", F.struct("at", "event_id"))
    found = numbered.withColumn("back", F.coalesce(back, F.lit(False))).groupBy(key, "run").agg(F.min("at").alias("run_start"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n_events"), F.max("place").alias("reached"), F.count_if("back").alias("n_back"), last.alias("kind"))
    status = F.when(F.col("kind").isin(*machine.completes), "completed").when(F.col("kind").isin(*machine.fails), "failed").otherwise("timed out")
    end = F.when(status == "timed out", F.timestamp_micros(F.unix_micros("last") + machine.timeout_seconds * 1_000_000)).otherwise(F.col("last"))
    return found.select(key, F.col("run_start").cast(kind_of_time).alias("run_start"), end.cast(kind_of_time).alias("run_end"), "n_events", "reached", "n_back", status.alias("status"))


class _Lifecycle(StatefulProcessor):
    """State of a key: events held back, and the open run. Times are microseconds."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event_id string, event_type string")
        self.run = handle.getValueState("run", "start long, last long, n long, reached int, place int, back long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.at_us, r.event_id, r.event_type) for r in rows]
        if new:
            self.held.appendList(new)
            self._wake(min(new)[0])
        return iter(())

    def _closed(self, key, run: tuple, end: int, status: str) -> Row:
        return Row(key=key[0], start_us=run[0], end_us=end, n_events=run[2], reached=run[3], n_back=run[5], status=status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rest = self.machine.timeout_seconds * 1_000_000
        every = [tuple(e) for e in self.held.get()] if self.held.exists() else []
        ready, later = sorted(e for e in every if e[0] < passed), [e for e in every if e[0] >= passed]
        run = tuple(self.run.get()) if self.run.exists() else None
        out = []
        for at, _, kind in ready:
            if run is not None and at - run[1] > rest:
                out.append(self._closed(key, run, run[1] + rest, "timed out"))
                run = None
            place = self.machine.place(kind)
            run = (at, at, 1, place, place, 0) if run is None else (run[0], at, run[2] + 1, max(run[3], place), place, run[5] + (run[4] > place))
            status = self.machine.status(kind)
            if status:
                out.append(self._closed(key, run, at, status))
                run = None
        if run is not None and run[1] + rest < passed:
            out.append(self._closed(key, run, run[1] + rest, "timed out"))
            run = None
        if every:
            if later:
                self.held.put(later)
                self._wake(min(later)[0])
            else:
                self.held.clear()
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
            self._wake(run[1] + rest)
        return iter(out)


def stream_runs(events: DataFrame, machine: Machine, key: str, at: str, event_id: str, event_type: str, late: str = "1 hour") -> DataFrame:
    """The rows of ``runs`` from a stream, each as soon as the watermark has passed its end; state stores on disk (RocksDB) are needed."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("at_us"), F.col(event_id).cast("string").alias("event_id"), F.col(event_type).alias("event_type"))
    out = rows.groupBy("key").transformWithState(_Lifecycle(machine), f"key {kind}, start_us long, end_us long, n_events long, reached int, n_back long, status string", "append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("start_us").alias("run_start"), F.timestamp_micros("end_us").alias("run_end"), "n_events", "reached", "n_back", "status")


#: The state store that keyed state and timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
