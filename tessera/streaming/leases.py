"""Leases of a work queue with a bound of active tasks a run, requeued or failed when they expire.

``EVENTS`` are ``(run_id, event_id, task_id, kind, claim_id, at, lease_seconds, max_attempts)``; kinds are ``enqueue``,
``claim``, ``heartbeat``, ``release`` and ``complete``. They are folded in order of (``at``, ``event_id``) for each run:

- a claim of a ready task is granted while fewer than ``most_active`` tasks of the run are held, else ``rejected``
- a heartbeat moves the end of its own lease; a release makes the task ready again; a completion ends it
- a lease that reaches its end is ``requeued``, or ``failed`` at the last of ``max_attempts``; ends come before events of the same time
- what doesn't fit the task's state, or isn't from the claim that holds it, is ``rejected``

``lease_history`` folds a table, ``lease_stream`` a stream; they agree on all rows that a stream takes before its watermark
has passed them. A stream holds events back until the watermark passes their time, so that disorder within the lateness
changes nothing; events delivered again count once, those behind the watermark are dropped by Spark.

Edge cases: events without run, task or time are left out; a repeated ``event_id`` of a run counts once (the first of its
repeats in order); equal times go by ``event_id``; an empty table gives an empty result. A table is folded as a sorted
stream of rows: a task holds the tasks of one run that are open, never a run's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, task_id long, kind string, claim_id string, at timestamp, lease_seconds long, max_attempts long"
HISTORY = "run_id long, task_id long, claim_id string, status string, attempts long, at_ms long"
_COLUMNS = ("event_id", "task_id", "kind", "claim_id", "at_ms", "lease_seconds", "max_attempts")
_PENDING = "event_id long, task_id long, kind string, claim_id string, at_ms long, lease_seconds long, max_attempts long"
_TASK = "state string, attempts long, max_attempts long, claim_id string, until_ms long"


class Run:
    """The open tasks of a run: ``task_id -> [state, attempts, max_attempts, claim_id, until_ms]``."""

    def __init__(self, most_active: int, tasks: dict[int, list] | None = None) -> None:
        self.most_active, self.tasks = most_active, tasks or {}

    def expired(self, now: int) -> Iterator[tuple]:
        """Leases that end at ``now`` or before, in order of their ends."""
        over = sorted((t[4], k) for k, t in self.tasks.items() if t[0] == "claimed" and t[4] <= now)
        for until, task_id in over:
            task = self.tasks[task_id]
            claim, again = task[3], task[1] < task[2]
            yield task_id, claim, "requeued" if again else "failed", task[1], until
            task[0], task[3], task[4] = "ready", None, None
            if not again:
                del self.tasks[task_id]

    def step(self, event: tuple) -> Iterator[tuple]:
        """What an event does, after the leases that end by its time."""
        _, task_id, kind, claim, now, lease_seconds, max_attempts = event
        yield from self.expired(now)
        task = self.tasks.get(task_id)
        mine = task is not None and task[0] == "claimed" and task[3] == claim
        status = "rejected"
        if kind == "enqueue" and task is None:
            task = self.tasks[task_id] = ["ready", 0, max(1, int(max_attempts or 1)), None, None]
            status = "ready"
        elif kind == "claim" and task is not None and task[0] == "ready" and sum(t[0] == "claimed" for t in self.tasks.values()) < self.most_active:
            task[:] = ["claimed", task[1] + 1, task[2], claim, now + 1000 * int(lease_seconds or 0)]
            status = "claimed"
        elif kind == "heartbeat" and mine:
            task[4], status = now + 1000 * int(lease_seconds or 0), "renewed"
        elif kind == "release" and mine:
            task[0], task[3], task[4], status = "ready", None, None, "released"
        elif kind == "complete" and mine:
            status = "completed"
            del self.tasks[task_id]
        yield task_id, claim, status, task[1] if task else 0, now


def _plain(events: DataFrame) -> DataFrame:
    known = events.filter("run_id IS NOT NULL AND task_id IS NOT NULL AND at IS NOT NULL")
    return known.select(F.col("run_id").cast("long"), "event_id", "task_id", "kind", "claim_id", F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), "lease_seconds", "max_attempts")


def _none(x: object) -> object:
    return None if x is None or x != x else x


def lease_history(events: DataFrame, most_active: int, until: str | None = None) -> DataFrame:
    """``HISTORY`` of a table of events; leases that end by ``until`` (the run's last event, if that isn't given) are ended."""
    limit = events.sparkSession.range(1).select(F.unix_millis(F.to_timestamp(F.lit(until)))).first()[0] if until else None

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_id, run, last, seen_at, seen = None, Run(most_active), None, None, set()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if row.run_id != run_id:
                    out += [(run_id, *x) for x in run.expired(limit if limit is not None else last if last is not None else -1)]
                    run_id, run, seen_at, seen = row.run_id, Run(most_active), None, set()
                event = tuple(_none(getattr(row, c)) for c in _COLUMNS)
                if event[4] != seen_at:  # repeats have the time of the first
                    seen_at, seen = event[4], set()
                if event[0] in seen:
                    continue
                seen.add(event[0])
                last = event[4]
                out += [(run_id, *x) for x in run.step(event)]
            yield _frame(out)
        yield _frame([(run_id, *x) for x in run.expired(limit if limit is not None else last if last is not None else -1)])

    ordered = _plain(events).drop("at").repartition("run_id").sortWithinPartitions("run_id", "at_ms", "event_id")
    return ordered.mapInPandas(fold, HISTORY)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["run_id", "task_id", "claim_id", "status", "attempts", "at_ms"])


class LeaseProcessor(StatefulProcessor):
    """Events of a run that the watermark hasn't passed, and its open tasks; a timer at the next event or end of a lease."""

    def __init__(self, most_active: int) -> None:
        self.most_active = most_active

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.tasks = handle.getMapState("tasks", "task_id long", _TASK)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        added = [tuple(_none(getattr(r, c)) for c in _COLUMNS) for batch in rows for r in batch.itertuples(index=False)]
        held = {e[:2] + (e[4],) for e in self.pending.get()}
        fresh = []
        for event in added:
            if event[:2] + (event[4],) not in held:
                held.add(event[:2] + (event[4],))
                fresh.append(event)
        if fresh:
            self.pending.appendList(fresh)
            self.handle.registerTimer(min(e[4] for e in fresh))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        run = Run(self.most_active, {int(k[0]): list(v) for k, v in self.tasks.iterator()})
        before = set(run.tasks)
        events = sorted(tuple(e) for e in self.pending.get())
        events.sort(key=lambda e: (e[4], e[0]))
        out = []
        for event in events:
            if event[4] <= now:
                out += run.step(event)
        out += run.expired(now)
        later = [e for e in events if e[4] > now]
        self.pending.clear()
        if later:
            self.pending.put(later)
        for gone in before - set(run.tasks):
            self.tasks.removeKey((gone,))
        for task_id, task in run.tasks.items():
            self.tasks.updateValue((task_id,), tuple(task))
        times = [e[4] for e in later] + [t[4] for t in run.tasks.values() if t[0] == "claimed"]
        if times:
            self.handle.registerTimer(min(times))
        yield _frame([(int(key[0]), *x) for x in out])

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, most_active: int, late: str = "1 minute") -> DataFrame:
    """``HISTORY`` of a stream of events; the session's state store must be RocksDB's."""
    rows = _plain(events).withWatermark("at", late)
    return rows.groupBy("run_id").transformWithStateInPandas(LeaseProcessor(most_active), HISTORY, "Append", "EventTime")
