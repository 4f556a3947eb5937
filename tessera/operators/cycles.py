"""Cycles of a dependency graph by forward-backward colouring, and a total order of what is free of them.

Nodes that can't be on a cycle (nothing before or nothing behind them) are taken off first, as long as there are any. Of the rest
each takes, along the edges, the least node that reaches it as its colour; the members of a colour that reach its root backwards,
without leaving the colour, are one strongly connected component. They go, and rounds begin anew with what is left. Only what
changed goes on to the next step; each step is written to the shared folder.

Edge cases: repeated edges count once; edges with a null end are left out; a node that needs itself is a cycle of its own; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import topological_levels
from .ranking import numbered
from .storage import saved


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have some before and some behind them."""
    n = edges.count()
    while True:
        inner = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        edges = saved(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        left = edges.count()
        if left == n:
            return edges
        n = left


def _coloured(edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the least node from which each is reached, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    colours = saved(nodes.withColumn("colour", F.col("node")))
    news = colours
    while not news.isEmpty():
        offered = edges.join(news.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        news = saved(colours.join(offered, "node").filter("offer < colour").select("node", F.col("offer").alias("colour")))
        colours = saved(colours.join(news.withColumnRenamed("colour", "now"), "node", "left").select("node", F.coalesce("now", "colour").alias("colour")))
    return colours


def _components(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """``(node, component)``: for each colour the nodes from which its root is reached within it."""
    side = lambda name: colours.select(F.col("node").alias(name), F.col("colour").alias(f"{name}_colour"))
    back = saved(edges.join(side("src"), "src").join(side("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst"))
    found = saved(colours.filter("node = colour").select("node", F.col("colour").alias("component")))
    news = found
    while not news.isEmpty():
        before = back.join(news.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component").distinct()
        news = saved(before.join(found, ["node", "component"], "left_anti"))
        found = saved(found.unionByName(news))
    return found


def cycle_members(edges: DataFrame) -> DataFrame:
    """``(node, component, size)`` of the nodes on cycles of ``edges(src, dst)``; a component is named by its least node."""
    edges = saved(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left = _trimmed(edges.filter("src <> dst"))
    out = None
    while not left.isEmpty():
        part = saved(_components(left, _coloured(left)))
        out = part if out is None else out.unionByName(part)
        gone = part.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _trimmed(saved(rest))
    every = loops if out is None else out.unionByName(loops.join(out.select("node"), "node", "left_anti"))
    sizes = every.groupBy("component").agg(F.count("*").alias("size"))
    counted = every.join(sizes, "component")
    itself = loops.select(F.col("node").alias("_loop"))
    return counted.join(itself, F.col("node") == F.col("_loop"), "left").filter("size > 1 OR _loop IS NOT NULL").select("node", "component", "size")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level, place)`` for ``edges(node, needs)``: level by level, in order of the nodes within one; null for those on or behind a cycle."""
    levels = saved(topological_levels(nodes, edges))
    free = numbered(levels.filter("level >= 0"), [F.col("level"), F.col("node")], "place")
    return free.select("node", "level", "place").unionByName(levels.filter("level < 0").select("node", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("place")))
