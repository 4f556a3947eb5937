"""Stateful operators of an append-only event log, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_state(events: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last event by ``order``; runs on batches and, in update or complete mode, on streams."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(key).agg(last.alias("_last"), F.count("*").alias("n_events")).select(key, "_last.*", "n_events")


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; on a stream, windows close ``late`` behind the newest event."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def replay_safe(events: DataFrame, event_id: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])
    return events.dropDuplicates([event_id])


def effective_tasks(tasks: DataFrame, claims: DataFrame, as_of: str) -> DataFrame:
    """Tasks with ``effective_state`` at a time: an expired lease is ready again, or failed at its last attempt."""
    now = F.to_timestamp(F.lit(as_of))
    held = claims.groupBy("task_id").agg(F.max("lease_expires_at").alias("until"))
    out = tasks.join(held, "task_id", "left")
    expired = (F.col("state") == "claimed") & (F.col("until") <= now)
    state = F.when(expired & (F.col("attempt_count") >= F.col("max_attempts")), "failed").when(expired, "ready").otherwise(F.col("state"))
    return out.withColumn("effective_state", state).drop("until")


def lease_events(claims: DataFrame, late: str = "1 minute") -> DataFrame:
    """``(task_id, claim_id, status)`` from a stream of ``(task_id, claim_id, at, lease_seconds, released)``.

    A claim of a task that is held is rejected; a lease that is neither renewed nor released expires
    when the watermark passes its end. State is one lease a task.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if held.hasTimedOut:
            claim, _ = held.get
            held.remove()
            yield pd.DataFrame({"task_id": [key[0]], "claim_id": [claim], "status": ["expired"]})
            return
        rows = pd.concat(list(batches)).sort_values(["at", "claim_id"])
        claim, until = held.get if held.exists else (None, 0)
        for row in rows.itertuples():
            now = int(row.at.timestamp() * 1000)
            if claim is not None and until <= now:
                out.append((claim, "expired"))
                claim = None
            if claim is None and not row.released:
                claim, until = row.claim_id, now + int(row.lease_seconds) * 1000
                out.append((claim, "claimed"))
            elif claim == row.claim_id:
                out.append((claim, "released" if row.released else "renewed"))
                claim, until = (None, 0) if row.released else (claim, now + int(row.lease_seconds) * 1000)
            else:
                out.append((row.claim_id, "rejected"))
        if claim is None:
            if held.exists:
                held.remove()
        else:
            held.update((claim, until))
            held.setTimeoutTimestamp(max(until, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": key[0], "claim_id": [c for c, _ in out], "status": [s for _, s in out]})

    return claims.withWatermark("at", late).groupBy("task_id").applyInPandasWithState(
        step, "task_id long, claim_id string, status string", "claim_id string, until long", "append", GroupStateTimeout.EventTimeTimeout
    )
