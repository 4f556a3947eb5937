"""Joins that never guess: what isn't unique becomes an unresolved row with a reason."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_unique(left: DataFrame, candidates: DataFrame, keys: Sequence[str], left_id: str, candidate_id: str) -> DataFrame:
    """Each row of ``left`` with ``target``, ``candidate_count`` and ``reason``.

    Reasons: resolved, missing_source_value, no_target, ambiguous_target, self_target. Candidates
    are counted by key before the join, so a key with many of them isn't multiplied.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "") for k in keys])
    by_key = candidates.filter(complete).groupBy(*keys).agg(F.countDistinct(candidate_id).alias("candidate_count"), F.min(candidate_id).alias("target"))
    joined = left.join(by_key, list(keys), "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    reason = (
        F.when(~complete, "missing_source_value").when(F.col("candidate_count") == 0, "no_target")
        .when(F.col("candidate_count") > 1, "ambiguous_target").when(F.col("target") == F.col(left_id), "self_target").otherwise("resolved")
    )
    out = joined.withColumn("reason", reason)
    return out.withColumn("target", F.when(F.col("reason") == "resolved", F.col("target")))


def first_kind_wins(left: DataFrame, kinds: Sequence[DataFrame], keys: Sequence[str], left_id: str, candidate_id: str) -> DataFrame:
    """As ``resolve_unique``, over the first of ``kinds`` that has any candidate for the key."""
    ranked = reduce(lambda a, b: a.unionByName(b), [k.select(*keys, candidate_id).withColumn("kind_rank", F.lit(i)) for i, k in enumerate(kinds)])
    best = ranked.groupBy(*keys).agg(F.min("kind_rank").alias("kind_rank"))
    return resolve_unique(left, ranked.join(best, [*keys, "kind_rank"]), keys, left_id, candidate_id)


def snapshot_diff(source: DataFrame, target: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``(key, change_type, changed_fields)`` of keys that are added, deleted or modified; equal rows don't appear."""
    packed = lambda df, name: df.select(key, F.struct(*[F.col(v).cast("string").alias(v) for v in values]).alias(name))
    both = packed(source, "before").join(packed(target, "after"), key, "full_outer")
    changed = F.filter(
        F.array(*[F.when(~F.col(f"before.{v}").eqNullSafe(F.col(f"after.{v}")), F.lit(v)) for v in sorted(values)]),
        lambda f: f.isNotNull(),
    )
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.size(changed) > 0, "modified")
    return both.select(key, kind.alias("change_type"), changed.alias("changed_fields")).filter("change_type is not null")


def sibling_band(rows: DataFrame, seeds: DataFrame, parent: str, ordinal: str, distance: int) -> DataFrame:
    """Pairs ``(parent, seed_ordinal, ordinal)`` of siblings up to ``distance`` apart: an equi-join on exploded places."""
    reach = seeds.select(parent, F.col(ordinal).alias("seed_ordinal"), F.explode(F.sequence(F.col(ordinal).cast("long") - distance, F.col(ordinal).cast("long") + distance)).alias(ordinal))
    return reach.join(rows.select(parent, F.col(ordinal).cast("long").alias(ordinal)), [parent, ordinal]).filter(F.col("seed_ordinal") != F.col(ordinal)).distinct()


def other_endpoints(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """``(node, other)`` for edges at either of whose ends a node stands: two equi-joins in place of an OR."""
    forth = nodes.join(edges, nodes[node] == edges[a]).select(nodes[node], edges[b].alias("other"))
    back = nodes.join(edges, nodes[node] == edges[b]).select(nodes[node], edges[a].alias("other"))
    return forth.unionByName(back).distinct()


def match_routes(routes: DataFrame, templates: DataFrame, route: str, template: str, template_id: str) -> DataFrame:
    """``(route, reason, template_id, candidate_count)``: segment-wise matches, ``{*}`` being any one segment.

    Templates meet routes by their number of segments and their first literal one, if they begin with one.
    """
    parts = lambda c: F.split(F.regexp_replace(c, "^/", ""), "/")
    r = routes.select(route).distinct().withColumn("r_parts", parts(F.col(route)))
    t = templates.select(template_id, template).withColumn("t_parts", parts(F.col(template)))
    r = r.withColumn("n", F.size("r_parts")).withColumn("head", F.explode(F.array(F.get("r_parts", F.lit(0)), F.lit("{*}"))))
    t = t.withColumn("n", F.size("t_parts")).withColumn("head", F.get("t_parts", F.lit(0)))
    fits = F.forall(F.zip_with("r_parts", "t_parts", lambda x, y: (x == y) | (y == "{*}")), lambda ok: ok)
    found = r.join(t, ["n", "head"]).filter(fits).groupBy(route).agg(F.countDistinct(template_id).alias("candidate_count"), F.min(template_id).alias("m"))
    out = routes.select(route).distinct().join(found, route, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    reason = F.when(F.col("candidate_count") == 0, "endpoint_not_found").when(F.col("candidate_count") > 1, "endpoint_ambiguous").otherwise("resolved_unique")
    return out.select(route, reason.alias("reason"), F.when(reason == "resolved_unique", F.col("m")).alias(template_id), "candidate_count")


def innermost_interval(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, interval_id: str, width: int = 64) -> DataFrame:
    """Each point with the shortest interval of its key around it (null if none): intervals and points meet in bins."""
    binned = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("bin", F.floor(F.col(point) / width))
    joined = p.join(binned, [key, "bin"]).filter(F.col(point).between(F.col(start), F.col(end)))
    best = joined.groupBy(key, point).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("length"), F.col(interval_id).alias("id"))).alias("m"))
    return points.join(best, [key, point], "left").withColumn(interval_id, F.col("m.id")).drop("m")


def close_findings(findings: DataFrame, edges: DataFrame, finding_id: str, edge_id: str, ways: Sequence[str]) -> DataFrame:
    """Findings with ``closed_by``: the only edge that any of the ``ways`` (common columns) leads to.

    ``edge_count`` is that of the way with most edges, or 2 if ways with one edge each lead to different ones. Edges
    are counted by key before they meet findings, so a frequent value multiplies nothing.
    """
    best = findings
    for i, w in enumerate(ways):
        by_key = edges.filter(F.col(w).isNotNull()).groupBy(w).agg(F.countDistinct(edge_id).alias(f"_n{i}"), F.min(edge_id).alias(f"_lo{i}"), F.max(edge_id).alias(f"_hi{i}"))
        best = best.join(by_key, w, "left")
    some = lambda name: [F.col(f"_{name}{i}") for i in range(len(ways))]
    pick = lambda f, columns: f(*columns) if len(columns) > 1 else columns[0]
    most, low, high = F.coalesce(pick(F.greatest, some("n")), F.lit(0)), pick(F.least, some("lo")), pick(F.greatest, some("hi"))
    count = F.when((most == 1) & (low != high), F.lit(2)).otherwise(most).cast("long")
    return best.select(finding_id, F.when((most == 1) & (low == high), low).alias("closed_by"), count.alias("edge_count"))


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by ``order`` (descending columns, ending with an id)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
