"""Closures, orders and incremental plans over edge tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import saved, shared_folder


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``(node, distance)`` of what undirected ``edges(src, dst)`` reach from ``seeds(node)`` in at most ``hops``."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    last = reached
    for hop in range(1, hops + 1):
        last = last.join(both, last.node == both.src).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("distance", F.lit(hop))
        reached = reached.unionByName(last)
    return reached


def transitive_closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(src, dst)`` of all paths along ``edges(src, dst)``, by doubling path lengths until none is new.

    Only paths that the last round found are prolonged, by all paths that are known.
    """
    last = saved(edges.select("src", "dst").distinct())
    paths = last
    for _ in range(most_rounds):
        if last.isEmpty():
            return paths
        onward = paths.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        longer = last.join(onward, "dst").select("src", F.col("end").alias("dst")).distinct()
        last = saved(longer.join(paths, ["src", "dst"], "left_anti"))
        paths = saved(paths.unionByName(last))
    raise RuntimeError(f"paths still grew after {most_rounds} rounds")


def topological_levels(nodes: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``(node, level)`` for ``edges(node, needs)``: 0 for nodes that need nothing; -1 for those on or behind a cycle.

    Levels are taken off until none is free, each appended to a table; more than ``most_rounds`` of them are an error.
    """
    spark = nodes.sparkSession
    table = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    left = saved(nodes.select("node").distinct())
    left.withColumn("level", F.lit(-1)).limit(0).write.parquet(table)
    for level in range(most_rounds):
        held = edges.join(left.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node").distinct()
        free = saved(left.join(held, "node", "left_anti"))
        if free.isEmpty():
            break
        free.withColumn("level", F.lit(level)).write.mode("append").parquet(table)
        left = saved(left.join(free, "node", "left_anti"))
    else:
        raise RuntimeError(f"levels still came off after {most_rounds} rounds")
    return spark.read.parquet(table).unionByName(left.withColumn("level", F.lit(-1)))


def incremental_plan(old: DataFrame, new: DataFrame, links: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, action)``: added, changed, removed, affected (one link from one of these) or reused.

    ``links(key, uses)``: what a row uses.
    """
    o, n = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    both = o.join(n, key, "full_outer")
    own = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    both = both.select(key, own.alias("own"))
    touched = both.filter("own is not null").select(F.col(key).alias("uses"))
    affected = links.join(touched, "uses", "left_semi").select(key).distinct().withColumn("hit", F.lit(1))
    return both.join(affected, key, "left").select(key, F.coalesce("own", F.when(F.col("hit") == 1, "affected"), F.lit("reused")).alias("action"))


def affected_by(changed: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``(key)`` of ``changed(key)`` and of all that uses one of them over any number of ``links(key, uses)``; only new ones go on to the next round."""
    found = saved(changed.select(key).distinct())
    news = found
    while not news.isEmpty():
        users = links.join(news.withColumnRenamed(key, "uses"), "uses", "left_semi").select(key).distinct()
        news = saved(users.join(found, key, "left_anti"))
        found = saved(found.unionByName(news))
    return found


def incremental_rescan(results: DataFrame, old: DataFrame, new: DataFrame, links: DataFrame, key: str, digest: str, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of ``scan`` over all of ``new``, with ``rescanned``: rows that no change reaches are taken from ``results`` of the scan before.

    ``scan`` takes the rows to be scanned and returns rows of the columns of ``results``; what it says of a row may depend on the
    rows that this one uses. Removed rows go.
    """
    o, n = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    changed = o.join(n, key, "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")) | F.col("o").isNull() | F.col("n").isNull()).select(key)
    touched = affected_by(changed, links, key)
    again = scan(new.join(touched, key, "left_semi")).withColumn("rescanned", F.lit(True))
    kept = results.join(touched, key, "left_anti").withColumn("rescanned", F.lit(False))
    return kept.unionByName(again)


def same_record(values: DataFrame, group: str, source: str, name: str, value: str) -> DataFrame:
    """``(group, sources, connected)``: whether shared (name, value) pairs link all of a group's sources, in chains if need be."""
    rows = values.filter(F.col(value).isNotNull()).select(group, F.col(source).alias("s"), name, value).distinct()
    hub = rows.groupBy(group, name, value).agg(F.min("s").alias("h"), F.count("*").alias("n")).filter("n > 1")
    links = rows.join(hub, [group, name, value]).filter("s <> h").select(group, "s", "h").distinct()
    key = lambda c: F.to_json(F.struct(F.col(group), F.col(c).alias("s")))
    parts = connected_components(links.select(key("s").alias("u"), key("h").alias("v")))
    members = values.select(group, F.col(source).alias("s")).distinct().withColumn("node", key("s")).join(parts, "node", "left")
    out = members.groupBy(group).agg(F.count("*").alias("sources"), F.countDistinct(F.coalesce("component", "node")).alias("parts"))
    return out.select(group, "sources", (F.col("parts") == 1).alias("connected"))
