"""The audit log: pipeline runs and stage events as tables of committed appends.

    <root>/runs      one row each time that a run is recorded; the last one counts
    <root>/events    whole frames of events
    <root>/jsonl     the same events as JSON lines, if asked for

Stages that run as a plan write a whole frame of events at once (``append``); with
a write id (run, step, attempt) a step that is repeated leaves its events once.
What the driver does step by step is recorded through ``stage``, a context manager
whose events are kept in a buffer and written together.  Small writes are merged
when there are many.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.sources.delta import AppendLog

RUNS = "run_id string, started_at timestamp, finished_at timestamp, source_type string, source_instance string, mode string, status string, total_events long"
EVENTS = (
    "id long, run_id string, source_type string, source_instance string, document_id string, document_uri string, document_title string, stage string, status string, "
    "reason_code string, message string, input_count int, output_count int, chunk_count int, duration_ms long, created_at timestamp, extra_json string"
)
UNKNOWN = "unknown_exception"


@dataclass
class Event:
    """One step of one document; without a status it is ok when its step ends."""

    run_id: str
    source_type: str
    stage: str
    source_instance: str | None = None
    document_id: str | None = None
    document_uri: str | None = None
    document_title: str | None = None
    status: str | None = None
    reason_code: str | None = None
    message: str | None = None
    input_count: int | None = None
    output_count: int | None = None
    chunk_count: int | None = None
    duration_ms: int | None = None
    created_at: datetime | None = None
    extra: dict = field(default_factory=dict)

    def set(self, status: str, reason_code: str | None = None, message: str | None = None) -> None:
        """How the step ended, where the step itself knows."""
        self.status, self.reason_code, self.message = status, reason_code, message


def outcome(event: Event, failure: BaseException | None) -> dict[str, str | None]:
    """Status, reason and message of a step: an error's own, unless the step has named a reason; ok where nothing was said."""
    if failure is None:
        return {"status": event.status or "ok", "reason_code": event.reason_code, "message": event.message}
    return {"status": "error", "reason_code": event.reason_code or UNKNOWN, "message": event.message or str(failure)}


class AuditLog:
    """Reads and writes the log under ``root``; ``jsonl`` mirrors events as JSON lines by run."""

    def __init__(self, spark: SparkSession, root: str, jsonl: bool = False, most: int = 1000):
        self.spark, self.root, self.jsonl, self.most = spark, root.rstrip("/"), jsonl, most
        self.buffer: list[Event] = []
        self._events = AppendLog(spark, f"{self.root}/events", T.StructType.fromDDL(EVENTS))
        self._runs = AppendLog(spark, f"{self.root}/runs", T.StructType.fromDDL(RUNS + ", recorded_at timestamp"))

    def events(self) -> DataFrame:
        return self._events.read()

    def runs(self) -> DataFrame:
        """The runs as last recorded; start and source type are those of their first record."""
        rows = self._runs.read()
        first, last = ["started_at", "source_type"], ["finished_at", "source_instance", "mode", "status", "total_events"]
        g = rows.groupBy("run_id").agg(F.min_by(F.struct(*first), "recorded_at").alias("a"), F.max_by(F.struct(*last), "recorded_at").alias("b"))
        return g.select("run_id", "a.*", "b.*").select(*T.StructType.fromDDL(RUNS).names)

    def record_run(self, run_id: str, source_type: str, status: str, started_at: datetime, finished_at: datetime | None = None, source_instance: str | None = None, mode: str | None = None, total_events: int = 0) -> None:
        row = (run_id, started_at, finished_at, source_type, source_instance, mode, status, total_events, datetime.now(UTC))
        self._runs.append(self.spark.createDataFrame([row], self._runs.schema).coalesce(1))

    @contextmanager
    def stage(self, event: Event) -> Iterator[Event]:
        """Times a step and records how it ended; an exception goes on after it is recorded."""
        began, failure = time.perf_counter(), None
        try:
            yield event
        except BaseException as e:
            failure = e
            raise
        finally:
            measured = {**outcome(event, failure), "duration_ms": round(1000 * (time.perf_counter() - began))}
            for name, value in measured.items():
                setattr(event, name, value)
            self.record(event)

    def record(self, event: Event) -> None:
        event.created_at = event.created_at or datetime.now(UTC)
        self.buffer.append(event)
        if len(self.buffer) >= self.most:
            self.flush()

    def flush(self, write_id: str | None = None) -> None:
        """Writes the events recorded so far."""
        if not self.buffer:
            return
        rows = []
        for e in self.buffer:
            d = asdict(e)
            d["extra_json"] = json.dumps(d.pop("extra"), ensure_ascii=False) if e.extra else None
            rows.append(d)
        names = [n for n in T.StructType.fromDDL(EVENTS).names if n != "id"]
        self.append(self.spark.createDataFrame([tuple(d[n] for n in names) for d in rows], EVENTS.removeprefix("id long, ")).coalesce(1), write_id)
        self.buffer = []

    def append(self, events: DataFrame, write_id: str | None = None) -> bool:
        """Appends a frame of events; columns that it lacks are null. False where its write id was appended before.

        Ids order the events of a write, created_at orders writes.
        """
        kind = T.StructType.fromDDL(EVENTS)
        given = {f.name: F.col(f.name).cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType) for f in kind.fields}
        given["id"] = F.monotonically_increasing_id()
        given["created_at"] = F.coalesce(given["created_at"], F.current_timestamp())
        rows = events.select(*[v.alias(n) for n, v in given.items()])
        if self.jsonl and not self._events.log.known(write_id):  # the mirror first: what a failed append leaves here is replaced when it is repeated
            name = re.sub(r"[^\w.-]", "_", write_id or uuid.uuid4().hex)
            rows.write.mode("overwrite").partitionBy("run_id").json(f"{self.root}/jsonl/write={name}")
        return self._events.append(rows, write_id)

    def count(self, run_id: str) -> int:
        return self.events().where(F.col("run_id") == run_id).count()
