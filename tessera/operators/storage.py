"""Intermediate tables in the folder that the cluster shares, and joins on keys that some rows crowd on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see; a local one is made in local mode alone."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="tessera-")


def saved(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``saved``, but as Parquet: smaller where rows are many, and later reads take the columns that they need."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    folder = f"{context.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Keys of a join that are broadcast, at most.
MOST_HOT = 1000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with ``facts``, one row for each ``key``, of which ``rows`` has ``n`` (``total`` in all).

    Keys with more than a MOST_HOT-th of all rows, which are fewer than MOST_HOT, are broadcast; so no task gets
    their rows. All others are shuffled. ``rows`` and ``facts`` are read twice: let them be written before.
    """
    hot = facts.filter(F.col(n) > total // MOST_HOT).drop(n)
    cold = facts.filter(F.col(n) <= total // MOST_HOT).drop(n)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(cold, key))
