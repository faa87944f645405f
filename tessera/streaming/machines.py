"""Rules that keep state between events of one key: leases, retries, taps, reuse and caches that end (Q6-Q8, Q11, Q14, Q24).

A machine is a step (what an event does to the state, and what is said of it) and, where time alone changes a state, the second at which
it lapses and how. The same steps run over a table, whose rows are folded in order without any key being held, and over a stream, where
`transformWithState` keeps a key's state and the events that the watermark has not passed; timers end leases and what is too old. Both
read events (key, at, seq, kind, n, text): in order of `at` and `seq`, a repeated (at, seq) once. Times are whole seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "at bigint, seq bigint, kind string, n bigint, text string"
SAID = "key string, at bigint, seq bigint, said string"
_KEPT = "status string, attempts bigint, until bigint, next bigint, seen boolean, gone bigint"

# Seconds of leases and answers, and attempts.
LEASE, CALL_LEASE, WORKER_LEASE = 120, 360, 120
DELIVERY_TRIES, NOTICE_TRIES = 10, 5
ANSWERS = {"member": 6 * 3600, "not_member": 60, "unknown": 120}
CHECKPOINT_DAYS = 86_400


class Event(NamedTuple):
    """What happens to a key: `n` is a number that the kind needs (a delay, an attempt, a time), `text` an outcome."""

    at: int
    seq: int
    kind: str
    n: int | None
    text: str | None


class Kept(NamedTuple):
    """The state of a key. `until` ends a lease or an answer, `next` is when to try again, `gone` when to forget."""

    status: str
    attempts: int = 0
    until: int | None = None
    next: int = 0
    seen: bool = False
    gone: int | None = None


Step = Callable[[Kept | None, Event], tuple[Kept | None, str]]


class Machine(NamedTuple):
    step: Step
    #: The second from which a state is another one without any event, and that one with what is said of it (nothing: None).
    lapses: Callable[[Kept], int | None] = lambda s: None
    lapsed: Callable[[Kept], tuple[Kept | None, str | None]] = lambda s: (s, None)


def _held(s: Kept, at: int) -> bool:
    return s.status == "sending" and s.until is not None and s.until > at


def deliveries(tries: int = DELIVERY_TRIES) -> Machine:
    """Q7. A file to be sent: "enqueue"; "look" takes it for LEASE seconds, unless it has ended, is leased or has to wait; "result" (text: a status, n: a delay) counts while it is being sent."""

    def step(s, e):
        s = s or Kept("pending")
        if e.kind == "look":
            if s.status in ("delivered", "failed", "blocked") or _held(s, e.at) or s.next > e.at:
                return s, "no"
            if s.attempts >= tries:
                return s._replace(status="failed", until=None), "exhausted"
            return s._replace(status="sending", until=e.at + LEASE, attempts=s.attempts + 1), "taken"
        if e.kind == "result" and s.status == "sending":
            return s._replace(status=e.text, until=None, next=e.at + (e.n or 0)), e.text
        return s, "no"

    return Machine(step)


def copies() -> Machine:
    """Q8. A campaign's copy: a lease that ran out is no second try but "interrupted", and a "tap" proves that the copy arrived; a "pause" (n: until when) holds looks back."""

    def step(s, e):
        s = s or Kept("pending")
        if e.kind == "tap":
            arrived = s.status in ("retrying", "failed")
            return s._replace(seen=True, status="delivered" if arrived else s.status, until=None if arrived else s.until), "arrived" if arrived else "seen"
        if e.kind == "pause":
            return s._replace(gone=max(s.gone or 0, e.n or 0)), "paused"
        if e.kind == "look":
            if s.status not in ("pending", "retrying", "sending"):
                return s, "no"
            if s.status == "sending":
                if _held(s, e.at):
                    return s, "no"
                return s._replace(status="delivered" if s.seen else "failed", until=None), "arrived" if s.seen else "interrupted"
            if s.status == "retrying" and s.seen:
                return s._replace(status="delivered", until=None), "arrived"
            if s.next > e.at or (s.gone or 0) > e.at:
                return s, "no"
            return s._replace(status="sending", until=e.at + LEASE, attempts=s.attempts + 1), "taken"
        if e.kind == "result" and s.status == "sending":
            status = "delivered" if s.seen and e.text in ("retrying", "failed") else e.text
            return s._replace(status=status, until=None, next=e.at + (e.n or 0)), status
        return s, "no"

    return Machine(step)


def notices(tries: int = NOTICE_TRIES) -> Machine:
    """Q11. A notice: waits count while it is being sent too, and a result counts for the attempt alone that it names (text: "3:delivered")."""

    def step(s, e):
        s = s or Kept("pending")
        if e.kind == "look":
            if s.status not in ("pending", "retrying", "sending") or s.next > e.at or _held(s, e.at):
                return s, "no"
            if s.attempts >= tries:
                return s._replace(status="failed", until=None), "exhausted"
            return s._replace(status="sending", until=e.at + LEASE, attempts=s.attempts + 1), "taken"
        if e.kind == "result" and s.status == "sending":
            attempt, status = e.text.split(":", 1)
            if int(attempt) == s.attempts:
                return s._replace(status=status, until=None, next=e.at + (e.n or 0)), status
        return s, "no"

    return Machine(step)


def workers() -> Machine:
    """Q6. A job that a worker has: "start" and "beat" lease it for n seconds, "settle" (text: how) ends it once; a lease that runs out fails it."""

    def step(s, e):
        if s is not None and s.status != "running":
            return s, "no"
        if e.kind == "settle" and s is not None:
            return s._replace(status=e.text, until=None), e.text
        if e.kind == "start" or (e.kind == "beat" and s is not None):
            return Kept("running", (s.attempts if s else 0) + 1, e.at + (e.n or WORKER_LEASE)), "leased"
        return s, "no"

    return Machine(step, lambda s: s.until if s.status == "running" else None, lambda s: (s._replace(status="failed", until=None), "worker_interrupted"))


def checkpoints() -> Machine:
    """Q14. A paid call by its request: "call" (n: when its result must go) reuses a result, is refused while another has the lease, or leases it;
    "done" and "error" (n: which lease, by the second it was taken) complete or free it. A result ends at its second; nothing older is reused."""

    def step(s, e):
        if s is not None and s.status == "completed" and (s.gone or 0) <= e.at:
            s = None
        if e.kind == "call":
            if (e.n or 0) <= e.at:
                return s, "called"
            if s is not None and s.status == "completed":
                return s, "reused"
            if s is not None and s.until is not None and s.until > e.at:
                return s, "refused"
            return Kept("pending", e.at, min(e.n, e.at + CALL_LEASE), gone=e.n), "called"
        if s is None or s.status != "pending" or s.until is None or s.attempts != e.n:
            return s, "no"
        if e.kind == "error":
            return s._replace(until=None), "freed"
        if (s.gone or 0) <= e.at:
            return s, "late"
        return s._replace(status="completed", until=None), "completed"

    return Machine(step, lambda s: s.gone, lambda s: (None, None))


def memberships(answers: dict[str, int] = ANSWERS) -> Machine:
    """Q24. Whether someone has joined: an answer is kept for as long as its kind is (text: member, not_member, unknown), then asked for again; "refresh" asks anyway. Unknown lets in."""

    def step(s, e):
        if s is not None and s.until > e.at and e.kind != "refresh":
            return s, "kept:" + s.status
        joined = "out" if e.text == "not_member" else "in"
        return Kept(joined, until=e.at + answers[e.text]), "asked:" + joined

    return Machine(step, lambda s: s.until, lambda s: (None, None))


def _lapse(machine: Machine, s: Kept | None, at: int) -> tuple[Kept | None, list[tuple[int, str]]]:
    """The state at a second, with what its own time brought until then."""
    said = []
    while s is not None and (when := machine.lapses(s)) is not None and when <= at:
        s, word = machine.lapsed(s)
        if word is not None:
            said.append((when, word))
    return s, said


def _walk(machine: Machine, s: Kept | None, events: Iterable[Event]) -> Iterator[tuple[Kept | None, int, int | None, str]]:
    """(state, at, seq, said) for each event and each lapse before it; a lapse has no seq."""
    for e in events:
        s, before = _lapse(machine, s, e.at)
        yield from ((s, at, None, word) for at, word in before)
        s, word = machine.step(s, e)
        yield s, e.at, e.seq, word


def over_table(events: DataFrame, machine: Machine, until: int) -> DataFrame:
    """key, at, seq, said of every event, and of lapses up to the second `until` (seq null). Rows are dealt by key and folded in order."""
    said = pa.schema([("key", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("said", pa.string())])

    def fold(batches):
        who, state, last = None, None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("key", "at", "seq", "kind", "n", "text")]
            for key, *values in zip(*columns, strict=True):
                e = Event(*values)
                if key != who:
                    if who is not None:
                        out += [(who, at, None, word) for at, word in _lapse(machine, state, until)[1]]
                    who, state, last = key, None, None
                if (e.at, e.seq) == last:
                    continue
                last = (e.at, e.seq)
                for state, at, seq, word in _walk(machine, state, [e]):
                    out.append((key, at, seq, word))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(said)], schema=said)
        if who is not None:
            end = [(who, at, None, word) for at, word in _lapse(machine, state, until)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in end], f.type) for i, f in enumerate(said)], schema=said)

    rows = events.select(F.col("key").cast("string"), *[F.col(c.split()[0]).cast(c.split()[1]) for c in EVENT.split(", ")]).filter("key IS NOT NULL AND at IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(fold, SAID)


class _Processor(StatefulProcessor):
    """Events wait until the watermark has passed them, so that late ones come in their order; then they step the machine."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _KEPT)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            self.waiting.appendValue((r["at"], r["seq"], r["kind"], r["n"], r["text"]))
            self.handle.registerTimer(max(r["at"] * 1000, passed + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        second = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = sorted({Event(*e)[:2]: Event(*e) for e in self.waiting.get()}.values())
        due = [e for e in waiting if e.at <= second]
        state = Kept(*self.kept.get()) if self.kept.exists() else None
        said = []
        for state, at, seq, word in _walk(self.machine, state, due):
            said.append(Row(key=key[0], at=at, seq=seq, said=word))
        state, lapsed = _lapse(self.machine, state, second)
        said += [Row(key=key[0], at=at, seq=None, said=word) for at, word in lapsed]
        if due:
            self.waiting.clear()
            for e in waiting[len(due) :]:
                self.waiting.appendValue(tuple(e))
        if state is None:
            self.kept.clear()
        else:
            self.kept.update(tuple(state))
            when = self.machine.lapses(state)
            if when is not None:
                self.handle.registerTimer(when * 1000)
        return iter(said)

    def close(self) -> None:
        pass


def over_stream(events: DataFrame, machine: Machine, late: str = "1 minute") -> DataFrame:
    """The same over a stream; an event later than the watermark is dropped. The session's state store has to be RocksDB."""
    rows = events.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", late).filter("key IS NOT NULL")
    return rows.groupBy("key").transformWithState(_Processor(machine), SAID, outputMode="append", timeMode="EventTime")
