"""Progress, readiness, recovery and propagation over keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capable(rows: DataFrame, needs: Column, offered: Sequence[str] | None = None, offers: Column | None = None) -> DataFrame:
    """Rows all of whose needed capabilities are offered: by a stated list, or by an array column of each row's own."""
    have = F.array(*[F.lit(x) for x in offered]) if offered is not None else offers
    return rows.filter(F.size(F.array_except(F.coalesce(needs, F.array().cast("array<string>")), have)) == 0)


def stage_progress(stages: DataFrame, key: str, stage: str, done: Column, name: str = "current_stage") -> DataFrame:
    """``(key, done, stages, name, percent)``: completed stages of all, and the first that isn't (in order of ``stage``)."""
    n = F.count_if(done)
    return stages.groupBy(key).agg(n.alias("done"), F.count("*").alias("stages"), F.min(F.when(~F.coalesce(done, F.lit(False)), F.col(stage))).alias(name), F.round(n * 100.0 / F.count("*")).alias("percent"))


def stage_states(stages: DataFrame, key: str, stage: str, state: str) -> DataFrame:
    """``stages`` with ``shown_state``: what comes after the first stage that isn't completed waits, whatever it says."""
    before = Window.partitionBy(key).orderBy(stage).rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.coalesce(F.max(F.col(state) != "completed").over(before), F.lit(False))
    return stages.withColumn("shown_state", F.when(blocked, "waiting").otherwise(F.col(state)))


def criterion_coverage(conditions: DataFrame, criterion: str, passed: Column, applies: Column | None = None) -> DataFrame:
    """``(criterion, n_conditions, covered, n_failed)``: all conditions that apply have to pass; a criterion without one isn't covered."""
    counts = F.lit(True) if applies is None else F.coalesce(applies, F.lit(False))
    ok = F.coalesce(passed, F.lit(False))
    out = conditions.groupBy(criterion).agg(F.count_if(counts).alias("n_conditions"), F.count_if(counts & ~ok).alias("n_failed"))
    return out.select(criterion, "n_conditions", ((F.col("n_failed") == 0) & (F.col("n_conditions") > 0)).alias("covered"), "n_failed")


def matched_parts(rows: DataFrame, key: str, text: str, pattern: str, name: str) -> DataFrame:
    """``(key, n, name)``: the first group of every match of a pattern in each text, in order."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), 1)
    return rows.select(key, F.size(found).cast("long").alias(f"n_{name}"), found.alias(name))


def folded_status(rows: DataFrame, key: str, levels: Sequence[tuple[str, Column]], otherwise: str, count: str = "cases") -> DataFrame:
    """``(key, count, status)``: the first level any row of the key meets, the gravest first."""
    status = F.lit(otherwise)
    for name, meets in reversed(levels):
        status = F.when(F.coalesce(F.bool_or(meets), F.lit(False)), name).otherwise(status)
    return rows.groupBy(key).agg(F.count("*").alias(count), status.alias("status"))


def rebuild_batches(tasks: DataFrame, scope: str, phase: str, task: str) -> DataFrame:
    """``tasks`` with their ``place`` in the scope by phase and id, and whether they are ``ready``: of the scope's first open phase."""
    own = Window.partitionBy(scope)
    return tasks.withColumns({"place": F.row_number().over(own.orderBy(phase, task)).cast("long"), "ready": F.col(phase) == F.min(phase).over(own)})


def recovered_runs(starts: DataFrame, run: str, at: str, stale_before: str) -> DataFrame:
    """``(run, started_at, state)``: runs whose last start is at or before a time are recovered, others go on."""
    runs = starts.groupBy(run).agg(F.max(at).alias("started_at"))
    return runs.withColumn("state", F.when(F.col("started_at") <= F.lit(stale_before).cast("timestamp"), "recovered").otherwise("running"))


def url_kinds(rows: DataFrame, url: str) -> DataFrame:
    """``(url, namespace, category, n)``: scheme (secure, plain, unknown) and host of each url, and how many rows have it."""
    c = F.col(url)
    scheme = F.when(c.startswith("https:"), "secure").when(c.startswith("http:"), "plain").otherwise("unknown")
    host = F.split_part(F.split_part(c, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return rows.groupBy(url).agg(F.count("*").alias("n")).select(url, scheme.alias("namespace"), host.alias("category"), "n")


def propagated(start: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows that a change reaches, table by table: each step ``(rows, column, column of the rows before)`` keeps the rows that refer to what was reached."""
    reached = start
    for rows, refers, to in steps:
        reached = rows.join(reached.select(F.col(to).alias("_reached")).distinct(), F.col(refers) == F.col("_reached"), "left_semi")
    return reached


def scenario_evidence(steps: DataFrame, flow: str, passed: Column, evidence: str, usable: Column) -> DataFrame:
    """``(flow, passed, steps, evidence)`` of flows all of whose steps are usable; evidence ids once each, in order."""
    out = steps.groupBy(flow).agg(F.bool_and(passed).alias("passed"), F.count("*").alias("steps"), F.array_sort(F.collect_set(evidence)).alias("evidence"), F.bool_and(F.coalesce(usable, F.lit(False))).alias("_all"))
    return out.filter("_all").drop("_all")
