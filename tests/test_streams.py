import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import diagnostics, leases

SCHEMA = f"run_id long, {leases.EVENTS}"


def brute(rows, most_active, until=None):
    """The history by a plain walk over the sorted events of each run."""
    out = []
    for run_id in sorted({r[0] for r in rows}):
        seen, tasks, last = set(), {}, 0
        events = sorted({(r[5], r[1], r) for r in rows if r[0] == run_id}, key=lambda e: e[:2])

        def end(now):
            while True:
                over = [(t["until"], k) for k, t in tasks.items() if t["claim"] is not None and t["until"] <= now]
                if not over:
                    return
                at, k = min(over)
                t = tasks[k]
                out.append((run_id, k, t["claim"], "requeued" if t["n"] < t["max"] else "failed", t["n"], at))
                if t["n"] < t["max"]:
                    t["claim"] = None
                else:
                    del tasks[k]

        for at, event_id, (_, _, task, kind, claim, _, lease, most) in events:
            if (event_id, at) in seen:
                continue
            seen.add((event_id, at))
            end(at)
            last, t = at, tasks.get(task)
            n, status = t["n"] if t else 0, "rejected"
            if kind == "enqueue" and t is None:
                tasks[task], status, n = {"n": 0, "max": most, "claim": None, "until": None}, "ready", 0
            elif kind == "claim" and t and t["claim"] is None and sum(x["claim"] is not None for x in tasks.values()) < most_active:
                t.update(n=t["n"] + 1, claim=claim, until=at + lease * 1000)
                status, n = "claimed", t["n"]
            elif t and t["claim"] is not None and t["claim"] == claim and kind in ("heartbeat", "release", "complete"):
                status = {"heartbeat": "renewed", "release": "released", "complete": "completed"}[kind]
                if kind == "heartbeat":
                    t["until"] = at + lease * 1000
                elif kind == "release":
                    t["claim"] = None
                else:
                    del tasks[task]
            out.append((run_id, task, claim, status, n, at))
        end(until if until is not None else last)
    return sorted(out, key=str)


def events(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run, task = rng.randrange(3), rng.randrange(6)
        kind = rng.choice(["enqueue", "claim", "claim", "claim", "heartbeat", "release", "complete"])
        rows.append((run, i, task, kind, f"c{rng.randrange(3)}", 1_700_000_000_000 + 1000 * rng.randrange(n), rng.randrange(1, 40), rng.randrange(1, 4)))
    return rows


def frame(spark, rows):
    plain = spark.createDataFrame(rows, "run_id long, event_id long, task_id long, kind string, claim_id string, ms long, lease_seconds long, max_attempts long")
    return plain.withColumn("at", F.timestamp_millis("ms")).select("run_id", "event_id", "task_id", "kind", "claim_id", "at", "lease_seconds", "max_attempts")


def test_history_of_a_table(spark):
    rows = events(1)
    table = frame(spark, rows + rows[:50]).unionByName(frame(spark, [(None, 1, 1, "claim", "c", 5, 1, 1), (1, 2, None, "claim", "c", 5, 1, 1)]))
    got = sorted((tuple(r) for r in leases.lease_history(table, 2).collect()), key=str)
    assert got == brute(rows, 2)
    assert {r[3] for r in got} == {"ready", "claimed", "renewed", "released", "completed", "requeued", "failed", "rejected"}
    far = sorted((tuple(r) for r in leases.lease_history(table, 2, "2030-01-01").collect()), key=str)
    assert far == brute(rows, 2, 1_893_456_000_000)
    assert leases.lease_history(table.limit(0), 2).count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream_equals_table(spark, rocks, tmp_path):
    """In three files, out of order within the lateness, some events twice; then one far later event that closes all."""
    rows = sorted(events(4, 240), key=lambda r: r[5])
    rng = random.Random(9)
    parts = [rows[:80], rows[80:160] + rows[60:80], rows[160:]]
    parts[0], held = [r for i, r in enumerate(parts[0]) if i % 9 or r[5] < rows[60][5]], [r for i, r in enumerate(rows[:80]) if not i % 9 and r[5] >= rows[60][5]]
    parts[1] += held
    end = rows[-1][5] + 3_600_000
    source, out = str(tmp_path / "in"), []
    for part in parts:
        rng.shuffle(part)
    stream = None
    try:
        for n, part in enumerate([*parts, [(99, 10**6, 1, "enqueue", "c", end, 1, 1)], [(99, 10**6 + 1, 2, "enqueue", "c", end + 1, 1, 1)]]):
            frame(spark, part).coalesce(1).write.mode("append").parquet(source)
            stream = stream or leases.lease_stream(spark.readStream.schema(SCHEMA).parquet(source), 2, "25 seconds").writeStream.foreachBatch(
                lambda b, _: out.extend(tuple(r) for r in b.collect())
            ).option("checkpointLocation", str(tmp_path / "check")).start()
            stream.processAllAvailable()
    finally:
        if stream:
            stream.stop()
    got = sorted((r for r in out if r[0] != 99), key=str)
    assert got == brute(rows, 2, end - 25_000)


def test_reports_are_forgotten(spark, rocks, tmp_path):
    schema, source, out = "consumer_id long, report_id long, observed_at timestamp, received_at timestamp", str(tmp_path / "in"), []
    now = "2025-01-01 12:00:00"
    rows = lambda *ids: spark.createDataFrame([(c, r) for c, r in ids], "consumer_id long, report_id long").withColumns({"observed_at": F.to_timestamp(F.lit(now)), "received_at": F.to_timestamp(F.lit(now)) + F.make_interval(secs=F.col("report_id"))})
    rows((1, 10), (2, 11)).coalesce(1).write.mode("append").parquet(source)
    stream = diagnostics.known_stream(spark.readStream.schema(schema).parquet(source), 12_000).writeStream.outputMode("update").foreachBatch(
        lambda b, _: out.append({tuple(r) for r in b.collect()})
    ).option("checkpointLocation", str(tmp_path / "check")).start()

    def answered(n):
        """Wait for the n-th answer: by the clock of the machine a stream never has nothing to do."""
        end = time.time() + 60
        while len([o for o in out if o]) < n and time.time() < end and stream.isActive:
            time.sleep(0.1)

    try:
        answered(1)
        rows((1, 9)).coalesce(1).write.mode("append").parquet(source)  # older than what is known
        answered(2)
        time.sleep(13)
        rows((1, 8), (3, 12)).coalesce(1).write.mode("append").parquet(source)
        answered(3)
    finally:
        stream.stop()
    assert [o for o in out if o] == [{(1, 10, False), (2, 11, False)}, {(1, 10, True)}, {(1, 8, False), (3, 12, False)}]


def test_reports_known_at_a_time(spark):
    t = lambda minutes: F.to_timestamp(F.lit("2025-01-01 12:00:00")) + F.make_interval(mins=F.lit(minutes))
    make = lambda c, r, observed, received: spark.range(1).select(F.lit(c).cast("long").alias("consumer_id"), F.lit(r).cast("long").alias("report_id"), t(observed).alias("observed_at"), t(received).alias("received_at"))
    reports = make(1, 1, 0, 0)
    for more in ((1, 2, 3, 4), (2, 3, 0, -11), (3, 4, 20, 3), (4, 5, -1500, 3), (None, 6, 0, 0), (5, 7, 9, 5), (6, 8, 0, 6)):
        reports = reports.unionByName(make(*more))
    assert [(r[0], r[1]) for r in diagnostics.known_at(reports, "2025-01-01 12:05:00").collect()] == [(5, 7), (1, 2)]
    assert [r[0] for r in diagnostics.known_at(reports, "2025-01-01 12:05:00", most=1).collect()] == [5]
    assert diagnostics.known_at(reports.limit(0), "2025-01-01 12:05:00").count() == 0
