"""Jobs of several stages that go on where they stopped: a stage runs again only when what it reads has changed.

A stage's fingerprint is made of its name, its settings and the fingerprint of what it reads: for the first stage the
files of the source, for each other one the stage before. Outputs and the table of states are in one versioned
folder, and a stage's output becomes visible together with its state, in one unit; so a job that is killed leaves
whole stages, each with its state, and nothing of the one that it was in. A rerun passes the stages whose
fingerprints are on record and starts at the first that differs.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import Store, fingerprint

STATE = "job_states"
STATE_DDL = "job string, stage string, place int, status string, fingerprint string, rows long, message string, changed_at timestamp"


@dataclass(frozen=True)
class Stage:
    """A step from a table to a table; ``settings`` are all that its result depends on besides what it reads."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    settings: dict = field(default_factory=dict)


class JobError(RuntimeError):
    """``code`` is ETL_JOB_EXECUTION_ERROR, ETL_JOB_CANCELLED, ETL_JOB_NOT_FOUND or ETL_VALIDATION_ERROR."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


class Job:
    """A named job over one store. ``cancel`` may be called from another thread; the job stops and can be run again."""

    def __init__(self, store: Store, name: str, stages: list[Stage]) -> None:
        names = [s.name for s in stages]
        if not stages or len(set(names)) < len(names):
            raise JobError("ETL_VALIDATION_ERROR", "a job needs stages of different names")
        self.store, self.spark, self.name, self.stages = store, store.spark, name, stages
        self._stop = threading.Event()
        self._tag = f"job-{uuid.uuid4().hex}"
        self.ran: list[str] = []

    def cancel(self) -> None:
        """Stop before the next stage, and interrupt the one that runs."""
        self._stop.set()

    def _watch(self, over: threading.Event) -> None:
        """Interrupt what runs under the job's tag from when the job is cancelled until the stage is over."""
        while not over.is_set():
            if self._stop.wait(0.2):
                self.spark.interruptTag(self._tag)
                over.wait(0.5)

    def _table(self, stage: Stage) -> str:
        return f"{self.name}__{stage.name}"

    def states(self) -> DataFrame:
        """A row per stage that has begun, in order."""
        if STATE not in self.store.manifest()["tables"]:
            return self.spark.createDataFrame([], STATE_DDL)
        return self.store.read(STATE).where(F.col("job") == self.name).orderBy("place")

    def _note(self, unit, stage: Stage, place: int, status: str, print_: str, rows: int | None = None, message: str | None = None) -> None:
        row = self.spark.createDataFrame([(self.name, stage.name, place, status, print_, rows, message)], STATE_DDL.removesuffix(", changed_at timestamp")).withColumn("changed_at", F.current_timestamp())
        if unit.has(STATE):
            unit.upsert(STATE, row)
        else:
            unit.append(STATE, row, ["job", "stage"], 8)

    def run(self, source: DataFrame) -> DataFrame:
        """The last stage's output. ``ran`` then names the stages that were not on record."""
        self._stop.clear()
        self.ran = []
        known = {r.stage: r for r in self.states().collect()}
        print_, rows = fingerprint(source), source
        for place, stage in enumerate(self.stages):
            if self._stop.is_set():
                raise JobError("ETL_JOB_CANCELLED", f"{self.name} before {stage.name}")
            print_ = hashlib.sha256(json.dumps([print_, stage.name, stage.settings], sort_keys=True, default=str).encode()).hexdigest()
            table, done = self._table(stage), known.get(stage.name)
            if not (done and done.status == "done" and done.fingerprint == print_):
                self.ran.append(stage.name)
                self._run(stage, place, print_, rows)
            rows = self.store.read(table)
        return rows

    def _run(self, stage: Stage, place: int, print_: str, rows: DataFrame) -> None:
        over = threading.Event()
        watch = threading.Thread(target=self._watch, args=(over,), daemon=True)
        self.spark.addTag(self._tag)
        watch.start()
        try:
            with self.store.begin() as unit:
                unit.replace(self._table(stage), stage.run(rows))
                if self._stop.is_set():
                    raise RuntimeError("cancelled")
                self._note(unit, stage, place, "done", print_, unit.read(self._table(stage)).count())
        except Exception as e:
            cancelled = self._stop.is_set()
            # What notes the end is not to be interrupted in its turn.
            over.set()
            watch.join()
            self.spark.removeTag(self._tag)
            with self.store.begin() as unit:
                self._note(unit, stage, place, "cancelled" if cancelled else "failed", print_, None, str(e)[:1000])
            raise JobError("ETL_JOB_CANCELLED" if cancelled else "ETL_JOB_EXECUTION_ERROR", f"{self.name} in {stage.name}: {str(e)[:300]}") from e
        finally:
            over.set()
            self.spark.removeTag(self._tag)


def output(spark: SparkSession, store: Store, job: str, stage: str) -> DataFrame:
    """What a stage has left, whether or not the job went on."""
    table = f"{job}__{stage}"
    if table not in store.manifest()["tables"]:
        raise JobError("ETL_JOB_NOT_FOUND", table)
    return store.read(table)
