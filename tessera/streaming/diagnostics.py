"""Diagnostic reports of consumers that are forgotten after a while.

A report is taken if it was observed at most ``EARLY`` after and ``OLD`` before it was received. Of each consumer the last
one taken is known, for ``RETENTION`` from when it was received, and of all consumers the ``MOST`` with the newest.

Edge cases: reports without consumer or times aren't taken; of reports received at the same time the one with the higher id
counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Bounds of reports.
EARLY, OLD, RETENTION, MOST = "5 minutes", "1 day", "15 minutes", 32


def taken(reports: DataFrame) -> DataFrame:
    """``reports(consumer_id, report_id, observed_at, received_at)`` that are neither too early nor too old."""
    seen, got = F.col("observed_at"), F.col("received_at")
    return reports.filter(F.col("consumer_id").isNotNull() & (seen <= got + F.expr(f"INTERVAL {EARLY}")) & (seen >= got - F.expr(f"INTERVAL {OLD}")))


def known_at(reports: DataFrame, now: str, retention: str = RETENTION, most: int = MOST) -> DataFrame:
    """``(consumer_id, report_id, received_at)``: what is known at a time, the newest ``most``."""
    at = F.to_timestamp(F.lit(now))
    live = taken(reports).filter((F.col("received_at") <= at) & (F.col("received_at") >= at - F.expr(f"INTERVAL {retention}")))
    last = live.groupBy("consumer_id").agg(F.max(F.struct("received_at", "report_id")).alias("m"))
    return last.select("consumer_id", "m.report_id", "m.received_at").orderBy(F.desc("received_at"), F.desc("report_id")).limit(most)


class _Known(StatefulProcessor):
    def __init__(self, retention_ms: int) -> None:
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "report_id long, received_ms long", ttlDurationMs=self.retention_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        newest = max((int(r.received_ms), int(r.report_id)) for batch in rows for r in batch.itertuples(index=False))
        held = self.last.get() if self.last.exists() else None
        known = (held[1], held[0]) if held is not None else None
        if known is None or newest > known:
            self.last.update((newest[1], newest[0]))
        yield pd.DataFrame({"consumer_id": [int(key[0])], "report_id": [max(newest, known or newest)[1]], "was_known": [known is not None]})

    def close(self) -> None:
        pass


def known_stream(reports: DataFrame, retention_ms: int) -> DataFrame:
    """``(consumer_id, report_id, was_known)``: the last report of each consumer that reports; state is forgotten ``retention_ms`` after it was written.

    ``was_known`` is whether an earlier report was still held.
    """
    rows = taken(reports).select("consumer_id", "report_id", F.unix_millis("received_at").alias("received_ms"))
    return rows.groupBy("consumer_id").transformWithStateInPandas(_Known(retention_ms), "consumer_id long, report_id long, was_known boolean", "Update", "ProcessingTime")
