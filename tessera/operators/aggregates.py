"""Aggregations over evidence: monitoring, coverage, quality metrics, conflicts, verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import join_counted, saved


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` rounded; null for an empty whole."""
    return F.round(part / F.when(whole != 0, whole), digits)


def conflicting_fields(candidates: DataFrame, record: str, field: str, value: str, order: str, required: Sequence[str]) -> DataFrame:
    """One row a record: its ``status`` (conflicting, missing or accepted), and the fields that made it so.

    A field with more than one distinct normalized value conflicts; its value is the first by ``order``.
    """
    norm = F.lower(F.trim(F.col(value)))
    fields = candidates.filter(F.col(value).isNotNull()).groupBy(record, field).agg(F.countDistinct(norm).alias("n"), F.min_by(value, order).alias("first"))
    per = fields.groupBy(record).agg(
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col(field)))).alias("conflicts"),
        F.collect_set(field).alias("present"),
    )
    per = candidates.select(record).distinct().join(per, record, "left")
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("present", F.array().cast("array<string>")))
    conflicts = F.coalesce("conflicts", F.array().cast("array<string>"))
    status = F.when(F.size(conflicts) > 0, "conflicting").when(F.size(missing) > 0, "missing").otherwise("accepted")
    return per.select(record, status.alias("status"), conflicts.alias("conflicts"), F.array_sort(missing).alias("missing"))


def best_variant(scores: DataFrame, subject: str, variant: str, score: str, threshold: float, tie: float = 1e-9) -> DataFrame:
    """``(subject, variant, score, reason)``: the best variant if it reaches the threshold and isn't tied."""
    top = scores.withColumn("_best", F.max(score).over(Window.partitionBy(subject)))
    near = top.filter(F.col("_best") - F.col(score) <= tie).groupBy(subject).agg(F.max("_best").alias("best"), F.count("*").alias("n"), F.min(variant).alias("v"))
    reason = F.when(F.col("best") < threshold, "below_threshold").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return near.select(subject, F.when(reason == "matched", F.col("v")).alias(variant), F.col("best").alias("score"), reason.alias("reason"))


def retrieval_quality(ranked: DataFrame, wanted: DataFrame, unwanted: DataFrame, query: str, target: str) -> DataFrame:
    """One row: recall at 5 and 10 and reciprocal rank averaged over queries, the rate of unwanted hits over all hits."""
    hits = wanted.join(ranked.select(query, target, "rank"), [query, target], "left")
    per = hits.groupBy(query).agg(
        (F.count_if(F.col("rank") <= 5) / F.count("*")).alias("r5"), (F.count_if(F.col("rank") <= 10) / F.count("*")).alias("r10"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"),
    )
    bad = ranked.join(unwanted.select(query, target).distinct().withColumn("bad", F.lit(1)), [query, target], "left")
    rates = bad.agg((F.count("bad") / F.when(F.count("*") > 0, F.count("*"))).alias("irrelevant_rate"))
    macro = per.agg(F.count("*").alias("n_queries"), F.avg("r5").alias("recall_at_5"), F.avg("r10").alias("recall_at_10"), F.avg("rr").alias("mrr"))
    return macro.crossJoin(rates)  # one row each


def changed_line_coverage(changed: DataFrame, executable: DataFrame, covered: DataFrame, known: DataFrame, least: float = 80.0) -> DataFrame:
    """``(path, changed_lines, covered_lines, percent, status)`` of line tables ``(path, line)``.

    Only executable changed lines count; a path that isn't in ``known`` has all its changed lines
    uncovered; none to cover is 100 percent.
    """
    flags = {"n": changed, "x": executable, "c": covered}
    mark = lambda df, line, name: df.select("path", line, *[F.lit(1 if f == name else 0).alias(f) for f in (*flags, "k")])
    rows = mark(known, F.lit(None).cast(changed.schema["line"].dataType).alias("line"), "k")
    for name, df in flags.items():
        rows = rows.unionByName(mark(df, "line", name))
    lines = rows.groupBy("path", "line").agg(*[F.max(f).alias(f) for f in (*flags, "k")])  # one scan a table, one row a line
    n, x, c = (F.col(f) == 1 for f in flags)
    sums = lines.groupBy("path").agg(F.max("k").alias("k"), F.count_if(n).alias("all"), F.count_if(n & x).alias("to_cover"), F.count_if(n & x & c).alias("hit")).filter(F.col("all") > 0)
    is_known = F.col("k") == 1
    counted = sums.select("path", F.when(is_known, F.col("to_cover")).otherwise(F.col("all")).alias("changed_lines"), F.when(is_known, F.col("hit")).otherwise(0).cast("long").alias("covered_lines"))
    percent = F.when(F.col("changed_lines") == 0, 100.0).otherwise(F.round(F.col("covered_lines") * 100.0 / F.col("changed_lines"), 2))
    return counted.withColumn("percent", percent).withColumn("status", F.when(F.col("percent") >= least, "passed").otherwise("failed"))


def relational_division(rows: DataFrame, group: str, member: str, wanted: DataFrame) -> DataFrame:
    """Groups that have every member of ``wanted(member)``."""
    need = wanted.select(member).distinct()
    n = need.agg(F.count("*").alias("need"))
    had = rows.join(need, member, "left_semi").groupBy(group).agg(F.countDistinct(member).alias("had"))
    return had.crossJoin(n).filter("had = need").select(group)  # n is one row


def verdict(violations: DataFrame, subjects: DataFrame, subject: str, severities: Sequence[str]) -> DataFrame:
    """``(subject, status, reasons)``: the gravest kind among a subject's violations ``(subject, kind, reason)``, else passed."""
    place = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[1], kv[0]), enumerate(severities), F.when(F.lit(False), -1))
    folded = violations.groupBy(subject).agg(F.min(place).alias("p"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    out = subjects.select(subject).distinct().join(folded, subject, "left")
    status = F.coalesce(F.get(F.array(*[F.lit(s) for s in severities]), F.col("p")), F.lit("passed"))
    return out.select(subject, status.alias("status"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def exact_quantile(rows: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """``(key, name)``: the interpolated quantile ``q`` of each key's values, exactly, without holding all values of a key.

    An approximate pass bounds the values around the quantile (its error is a fifth of the margin); a second one counts
    those below and ranks those between, which are a thousandth of all. Keys with few values have all of them ranked.
    """
    v = F.col(value)
    some = rows.filter(v.isNotNull()).select(key, value)
    sides = F.array(F.lit(max(q - 5e-4, 0.0)), F.lit(min(q + 5e-4, 1.0)))
    bounds = some.groupBy(key).agg(F.percentile_approx(v, sides, F.lit(10_000)).alias("_b"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.count("*").alias("_n"))
    few = F.col("_n") <= 10_000
    low, high = F.when(few, F.col("_min")).otherwise(F.col("_b")[0]), F.when(few, F.col("_max")).otherwise(F.col("_b")[1])
    bounds = saved(bounds.select(key, low.alias("_lo"), high.alias("_hi"), "_n", (F.lit(float(q)) * (F.col("_n") - 1)).alias("_at")))
    total = bounds.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    near = join_counted(some, bounds, key, "_n", total)
    below = near.groupBy(key).agg(F.count_if(v < F.col("_lo")).alias("_below"))
    cells = near.filter(v.between(F.col("_lo"), F.col("_hi"))).groupBy(key, value).agg(F.count("*").alias("_c"), F.first("_at").alias("_at"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value))
    ranked = cells.withColumn("_end", upto).join(below, key).withColumns({"_end": F.col("_end") + F.col("_below"), "_first": F.col("_end") + F.col("_below") - F.col("_c")})
    holds = lambda place: F.max(F.when((F.col("_first") <= place) & (place < F.col("_end")), v))
    low, high = holds(F.floor("_at")), holds(F.ceil("_at"))
    part = F.first("_at") - F.floor(F.first("_at"))
    return ranked.groupBy(key).agg((low + (high - low) * part).alias(name))


def overlapping_sets(sets: DataFrame, id_col: str, members: str, least: float) -> DataFrame:
    """``(a, b, overlap)`` of all pairs of ids (a < b) whose sets share at least ``least`` of their union.

    Prefix filter: with members in order of how few sets have them, two such sets share one of their first members.
    """
    rows = sets.filter(F.size(members) > 0).select(F.col(id_col).alias("a"), F.col(members).alias("ga"))
    each = rows.select("a", F.size("ga").alias("n"), F.explode("ga").alias("m"))
    rare = each.groupBy("m").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("df", "m"))
    heads = each.join(rare, "m").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("a", "n", "m")
    other = heads.select(F.col("a").alias("b"), F.col("n").alias("k"), "m")
    pairs = heads.join(other, "m").filter((F.col("a") < F.col("b")) & (F.least("n", "k") >= F.greatest("n", "k") * least - 1e-9)).select("a", "b").distinct()
    full = pairs.join(rows, "a").join(rows.select(F.col("a").alias("b"), F.col("ga").alias("gb")), "b")
    share = F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb"))
    return full.select("a", "b", share.alias("overlap")).filter(F.col("overlap") >= least)
