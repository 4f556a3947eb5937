"""Append-only publishing: replays are no-ops, other content under the same id is a conflict."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(*columns: str) -> F.Column:
    """A digest of named columns as canonical JSON: sorted names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def publish_plan(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, digest, action)`` of incoming rows: insert, replay, or conflict (also among themselves)."""
    own = incoming.groupBy(key).agg(F.countDistinct(digest).alias("n"), F.min(digest).alias(digest))
    known = stored.select(key, F.col(digest).alias("_stored"))
    out = own.join(known, key, "left")
    conflict = (F.col("n") > 1) | (F.col("_stored").isNotNull() & (F.col("_stored") != F.col(digest)))
    action = F.when(conflict, "conflict").when(F.col("_stored").isNotNull(), "replay").otherwise("insert")
    return out.select(key, digest, action.alias("action"))


def publish_build(rows: DataFrame, folder: str) -> str:
    """Write ``rows`` under a new build id, then the event that makes it ready; readers never see half a build."""
    build = uuid.uuid4().hex
    rows.write.parquet(f"{folder}/data/build={build}")
    event = rows.sparkSession.createDataFrame([(build, "ready")], "build string, status string").withColumn("at", F.current_timestamp())
    event.coalesce(1).write.mode("append").parquet(f"{folder}/events")
    return build


def current_build(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the latest ready build."""
    ready = spark.read.parquet(f"{folder}/events").filter("status = 'ready'")
    build = ready.agg(F.max_by("build", F.struct("at", "build")).alias("b")).first()["b"]
    return spark.read.parquet(f"{folder}/data/build={build}")


def accepted_appends(events: DataFrame, appends: DataFrame, key: str, sequence: str) -> DataFrame:
    """``(key, expected, latest, accepted)``: an append counts only if it names its key's latest event."""
    last = events.groupBy(key).agg(F.max(sequence).alias("latest"))
    out = appends.join(last, key, "left").withColumn("latest", F.coalesce("latest", F.lit(0).cast("long")))
    return out.withColumn("accepted", F.col("expected") == F.col("latest"))
