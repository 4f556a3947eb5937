"""Builds published under a ledger: rows first, then one event that makes them current.

A build's rows are written by Spark's own writer to a folder of their own; the build counts from the moment when its event stands in
the ledger, a single row under the next number. Two publishers that saw the same ledger want the same number, and the second one
fails. A build that breaks off before its event is never seen, and what was current stays so.

Of each kind and scope the build with the last event is current, all earlier ones are stale; so is a build that depends on a stale one, over
any number of steps. An event is never taken back: publishing a build again with the same content does nothing (a stale one stays stale),
with other content it is an error. A build of which something is ``wanted`` is published only if it has every key of it.

Edge cases: rows with null keys cover nothing; repeated rows are part of a build's content; a dependency that isn't in the ledger is an
error when publishing, and stale in ``build_status``; a build of no rows is one like any other (unless something is wanted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publishing import content_digest
from .storage import saved

EVENTS = "build string, kind string, scope string, digest string, n_rows long, depends_on array<string>, seq long"


class Conflict(ValueError):
    """Other content under a known build, a dependency or key that is missing, or a ledger that went on meanwhile."""


def rows_digest(rows: DataFrame) -> tuple[str, int]:
    """A digest of all rows, in whatever order, and their number."""
    content = rows.select(content_digest(*rows.columns).alias("d"))
    halves = [F.sum(F.conv(F.substring("d", i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 16, 31, 46)]
    found = content.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.lit(",".join(sorted(rows.columns))), F.count("*").cast("string"), *[F.coalesce(h, F.lit("0")) for h in halves]), 256).alias("digest")).first()
    return found["digest"], found["n"]


def build_status(events: DataFrame) -> DataFrame:
    """``(build, kind, scope, seq, current, status)`` of ``events(build, kind, scope, seq, depends_on)``: ``ready`` or ``stale``."""
    last = events.groupBy("kind", "scope").agg(F.max("seq").alias("_last"))
    known = saved(events.join(last, ["kind", "scope"]).withColumn("current", F.col("seq") == F.col("_last")).select("build", "kind", "scope", "seq", "current", F.coalesce("depends_on", F.array().cast(events.schema["depends_on"].dataType)).alias("depends_on")))
    links = saved(known.select("build", F.explode("depends_on").alias("needs")).distinct())
    unknown = links.join(known.select(F.col("build").alias("needs")), "needs", "left_anti").select("build")
    stale = saved(known.filter("NOT current").select("build").unionByName(unknown).distinct())
    news = stale
    while not news.isEmpty():  # a round for each step of dependency
        behind = links.join(news.withColumnRenamed("build", "needs"), "needs", "left_semi").select("build").distinct()
        news = saved(behind.join(stale, "build", "left_anti"))
        stale = saved(stale.unionByName(news))
    out = known.join(stale.withColumn("_stale", F.lit(True)), "build", "left")
    return out.select("build", "kind", "scope", "seq", "current", F.when(F.col("_stale"), "stale").otherwise("ready").alias("status"))


class Ledger:
    """The builds in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def events(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/events")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events").drop("number")

    def publish(self, build: str, kind: str, scope: str, rows: DataFrame, depends_on: Sequence[str] = (), wanted: DataFrame | None = None, expected: int | None = None) -> str:
        """``created`` or ``replayed``. ``wanted``: its first column names keys that ``rows`` must all have; ``expected``: the number of the ledger's last event."""
        events = self.events()
        digest, n_rows = rows_digest(rows)
        known = events.filter(F.col("build") == build).select("digest", "kind", "scope").first()
        if known is not None:
            if tuple(known) != (digest, kind, scope):
                raise Conflict(f"build {build} is known with other content")
            return "replayed"
        if depends_on:
            found = events.filter(F.col("build").isin(*depends_on)).agg(F.countDistinct("build")).first()[0]
            if found < len(set(depends_on)):
                raise Conflict(f"build {build} depends on builds that aren't known")
        if wanted is not None:
            key = wanted.columns[0]
            left = wanted.select(key).distinct().join(rows.select(key), key, "left_anti").count()
            if left:
                raise Conflict(f"build {build} leaves out {left} keys")
        last = events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        if expected is not None and expected != last:
            raise Conflict(f"the ledger is at {last}, not at {expected}")
        rows.write.mode("overwrite").parquet(f"{self.folder}/data/{build}")  # what an attempt that broke off left goes
        event = self.spark.createDataFrame([(build, kind, scope, digest, n_rows, list(depends_on), last + 1)], EVENTS)
        try:
            event.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/events/number={last + 1}")
        except Exception as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise Conflict(f"the ledger went on to {last + 1} meanwhile") from error
            raise
        return "created"

    def status(self) -> DataFrame:
        return build_status(self.events())

    def current(self, kind: str, scope: str) -> DataFrame | None:
        """The rows of the current build, if it isn't stale."""
        found = self.status().filter((F.col("kind") == kind) & (F.col("scope") == scope) & F.col("current") & (F.col("status") == "ready")).first()
        return self.spark.read.parquet(f"{self.folder}/data/{found['build']}") if found else None

    def intact(self, build: str) -> bool:
        """Whether a build's rows still are what its event says."""
        event = self.events().filter(F.col("build") == build).first()
        return event is not None and rows_digest(self.spark.read.parquet(f"{self.folder}/data/{build}")) == (event["digest"], event["n_rows"])
