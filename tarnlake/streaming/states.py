"""Keyed state of streams: jobs as state machines that time out, and values that expire."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: From each status the ones a job may go to. A job that is worked on may report progress; what is over stays over.
LEGAL = {None: {"pending"}, "pending": {"processing", "failed"}, "processing": {"processing", "completed", "failed"}, "completed": set(), "failed": set()}
#: Times are microseconds in here, so that no zone of a session touches them.
LOG = "id {kind}, event_id long, at long, status string, accepted boolean, reason string"
LOOKUPS = "id {kind}, event_id long, at long, hit boolean, computed_at long, value string"


def in_order(rows: Iterator[Row]) -> list[Row]:
    """All rows of a key in this batch, by time; of one time, by event, nulls last."""
    return sorted(rows, key=lambda r: (r["us"] is None, r["us"] or 0, r["event_id"] is None, r["event_id"] or 0))


def step(status: str | None, at: int | None, event: str | None, now: int, timeout: int) -> tuple[str | None, bool, int | None]:
    """The status after an event, whether it is legal, and the time (or none) at which the job had timed out before."""
    over = at + timeout if status == "processing" and now > at + timeout else None
    status = "failed" if over is not None else status
    legal = event in LEGAL[status]
    return (event if legal else status), legal, over


class JobStates(StatefulProcessor):
    """State of a job: status and the time of its last accepted event. A timer of event time fails a job that is in
    processing and silent for longer than the time-out; events that come later than that find it failed."""

    def __init__(self, timeout: int, columns: list[str]):
        self.timeout, self.row = timeout, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, at = before = self.state.get() or (None, None)
        for event_id, event, now in ((r["event_id"], r["event"], r["us"]) for r in in_order(rows)):
            after, legal, over = step(status, at, event, now, self.timeout)
            if over is not None:
                status, at = "failed", over
                yield self.row(key[0], None, over, "failed", True, "timed out")
            reason = None if legal else f"{status or 'nothing'} to {event}"
            yield self.row(key[0], event_id, now, after, legal, reason)
            if legal:
                status, at = after, now
        if (status, at) != before:
            if before[0] == "processing":
                self.handle.deleteTimer((before[1] + self.timeout) // 1000 + 1)
            if status == "processing":
                self.handle.registerTimer((at + self.timeout) // 1000 + 1)
            self.state.update((status, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, at = self.state.get() or (None, None)
        if status == "processing" and (at + self.timeout) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("failed", at + self.timeout))
            yield self.row(key[0], None, at + self.timeout, "failed", True, "timed out")

    def close(self) -> None:
        pass


class ExpiringValues(StatefulProcessor):
    """State of a key: its value and when it was computed. A lookup is a hit while that is no longer ago than the age; a later
    one computes anew. A timer of event time forgets what no lookup can hit any more, so state is what the last `age` holds."""

    def __init__(self, age: int, compute, columns: list[str]):
        self.age, self.compute, self.row = age, compute, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", "value string, computed_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        value, computed = self.state.get() or (None, None)
        first = computed
        for event_id, now in ((r["event_id"], r["us"]) for r in in_order(rows)):
            hit = computed is not None and now - computed <= self.age
            if not hit:
                value, computed = self.compute(key[0]), now
            yield self.row(key[0], event_id, now, hit, computed, value)
        if computed != first:
            self.state.update((value, computed))
            self.handle.registerTimer((computed + self.age) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held and (held[1] + self.age) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _stated(events: DataFrame, processor, schema: str, delay: str, times: list[str]) -> DataFrame:
    """events (id, event_id, at, ...) keyed by id, through the processor, in event time; `times` become timestamps again."""
    events.sparkSession.conf.set(STORE, ROCKS)  # the only store that has timers
    timed = events.withColumn("us", F.unix_micros("at")).withWatermark("at", delay)
    out = timed.groupBy("id").transformWithState(processor, schema, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


def _schema(events: DataFrame, form: str) -> tuple[str, list[str]]:
    schema = form.format(kind=events.schema["id"].dataType.simpleString())
    return schema, [part.split()[0] for part in schema.split(", ")]


def job_log(events: DataFrame, timeout_seconds: float, delay: str = "1 hour") -> DataFrame:
    """The log of jobs from their events (id, event_id, at, event), a stream or a table: a row per event with the status after it, whether it was
    accepted and why not, and a row per time-out.

    Events of a job are taken in the order of their times within a batch; what comes later than the watermark is dropped
    by Spark (route_late keeps it apart first). Null ids are a job like others; an event that is null is never legal."""
    schema, columns = _schema(events, LOG)
    return _stated(events, JobStates(int(timeout_seconds * 1e6), columns), schema, delay, ["at"])


def cached_lookups(lookups: DataFrame, compute, age_seconds: float, delay: str = "1 hour") -> DataFrame:
    """Each lookup (id, event_id, at) with its value, whether it was a hit, and when the value was computed.

    All tasks share what is computed, as a key's state is in one place; `compute` (id to text) is called for misses alone."""
    schema, columns = _schema(lookups, LOOKUPS)
    return _stated(lookups, ExpiringValues(int(age_seconds * 1e6), compute, columns), schema, delay, ["at", "computed_at"])


def final_states(log: DataFrame) -> DataFrame:
    """id, status, at, accepted and rejected (events) of each job, from its log."""
    order = F.struct("at", F.col("event_id").isNull(), "event_id")
    by = F.struct("status", "at")
    out = log.groupBy("id").agg(F.max_by(F.when(F.col("accepted"), by), F.when(F.col("accepted"), order)).alias("s"), F.count_if(F.col("accepted") & F.col("event_id").isNotNull()).alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    return out.select("id", "s.status", "s.at", "accepted", "rejected")
