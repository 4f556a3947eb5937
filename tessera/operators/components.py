"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import join_counted, saved


def _contract(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step: hang the larger (or else the smaller) neighbours of each node on its least one. ``edges`` are ``total``, about."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
    joined = join_counted(near, least.select("u", "m", "n"), "u", "n", total)
    least = least.select("u", "m")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(u, v)``; the component is its least node.

    Rounds end when the edges are stars. Each round's edges go to the checkpoint folder, so that
    a lost executor costs one round; only their number and a checksum come to the driver.
    """
    edges = saved(edges.select("u", "v").filter("u <> v").distinct())
    seen, total = None, edges.count()
    for _ in range(most_rounds):
        edges = saved(_contract(saved(_contract(edges, True, total)), False, total))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        total = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
