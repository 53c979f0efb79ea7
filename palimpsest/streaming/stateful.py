"""Keyed state over streams: session segments, leased work with retries, and digests behind an interval gate.

Each is a ``StatefulProcessor``: what it knows of a key lies in the state store, is checkpointed with the offsets and comes back
after a restart. The rules of a step are small functions of state and row; Spark deals keys to tasks and rows to keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that processors need, for streams that the session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Segments(StatefulProcessor):
    """Numbers the segments of sessions as their turns come in (see ``digest.segments``). State: the segment and its topic words."""

    OUT = "session_id string, turn_number int, role string, content string, segment int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._segment = handle.getValueState("segment", "segment int, words array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        segment, words = self._segment.get() if self._segment.exists() else (0, [])
        topic = set(words or [])
        for r in sorted(rows, key=lambda r: (r["turn_number"], r["role"], r["content"])):
            now = set(r["words"])
            if r["role"] == "user" and topic and now and not topic & now:
                segment, topic = segment + 1, set()
            topic |= now
            yield Row(session_id=key[0], turn_number=r["turn_number"], role=r["role"], content=r["content"], segment=segment)
        self._segment.update((segment, sorted(topic)))

    def close(self) -> None:
        pass


def streamed_segments(entries: DataFrame) -> DataFrame:
    """Segments of a stream of (session_id, turn_number, role, content, words). A session's turns come in order."""
    return entries.groupBy("session_id").transformWithState(Segments(), Segments.OUT, "Append", "None")


#: status, attempts, worker, end of the lease, earliest next claim; instants are microseconds since 1970
Work = tuple[str, int, str, int | None, int | None]


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def work_step(state: Work | None, kind: str, worker: str, at: int, lease: int, backoff: int, most: int) -> Work | None:
    """The state behind a command, or None if the command has no effect.

    ``enqueue`` makes new work; ``claim`` takes work that is pending, due for a retry, or whose lease has run out; ``complete`` and
    ``fail`` hold only for the worker that has it. After ``most`` attempts a failure is final.
    """
    if kind == "enqueue":
        return ("pending", 0, "", None, at) if state is None else None
    if state is None:
        return None
    status, attempts, holder, until, due = state
    if kind == "claim" and (status in ("pending", "retry") and due <= at or status == "processing" and until <= at):
        return "processing", attempts + 1, worker, at + lease, None
    if kind in ("complete", "fail") and status == "processing" and holder == worker:
        if kind == "complete":
            return "completed", attempts, "", None, None
        return ("dead_letter", attempts, "", None, None) if attempts >= most else ("retry", attempts, "", None, at + backoff)
    return None


class Leases(StatefulProcessor):
    """A durable queue of work: commands in, transitions out.

    Leases that run out are told of when event time passes their end, by a timer; the work is open to a claim from then on.
    """

    OUT = "key string, n long, at long, status string, attempts int, worker string"

    def __init__(self, lease: timedelta = timedelta(minutes=5), backoff: timedelta = timedelta(minutes=10), most: int = 8):
        self.lease, self.backoff, self.most = micros(lease), micros(backoff), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._work = handle.getValueState("work", "status string, attempts int, worker string, until long, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self._work.get()) if self._work.exists() else None
        for r in sorted(rows, key=lambda r: (r["micros"], r["n"])):
            new = work_step(state, r["kind"], r["worker"], r["micros"], self.lease, self.backoff, self.most)
            if new is None:
                continue
            if state and state[3]:
                self._handle.deleteTimer(state[3] // 1000)
            state = new
            if state[3]:
                self._handle.registerTimer(state[3] // 1000)
            yield Row(key=key[0], n=r["n"], at=r["micros"], status=state[0], attempts=state[1], worker=state[2])
        if state:
            self._work.update(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = tuple(self._work.get())
        if state[0] == "processing" and state[3] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            yield Row(key=key[0], n=-1, at=state[3], status="lease_expired", attempts=state[1], worker=state[2])

    def close(self) -> None:
        pass


def streamed_leases(commands: DataFrame, delay: str = "1 hour", **rules) -> DataFrame:
    """Transitions of a stream of commands (key, n, at, kind, worker); a key's commands come in order of (at, n)."""
    rows = commands.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    out = rows.groupBy("key").transformWithState(Leases(**rules), Leases.OUT, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


class Gate(StatefulProcessor):
    """Lets a digest of a scope begin when ``every`` has passed since the last began, with all that came since.

    State: when the last one began, and number and last entry of what waits.
    """

    OUT = "scope_id string, run int, at long, n long, last long"

    def __init__(self, every: timedelta):
        self.every = micros(every)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._gate = handle.getValueState("gate", "run int, began long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        run, began, n = self._gate.get() if self._gate.exists() else (0, None, 0)
        for r in sorted(rows, key=lambda r: (r["micros"], r["n"])):
            n += 1
            if began is None or r["micros"] - began >= self.every:
                run, began = run + 1, r["micros"]
                yield Row(scope_id=key[0], run=run, at=began, n=n, last=r["n"])
                n = 0
        self._gate.update((run, began, n))

    def close(self) -> None:
        pass


def streamed_gate(entries: DataFrame, every: timedelta) -> DataFrame:
    """The digests that a stream of entries (scope_id, n, at) sets off: (scope_id, run, at, number of entries, the last of them)."""
    out = entries.withColumn("micros", F.unix_micros("at")).groupBy("scope_id").transformWithState(Gate(every), Gate.OUT, "Append", "None")
    return out.withColumn("at", F.timestamp_micros("at"))
