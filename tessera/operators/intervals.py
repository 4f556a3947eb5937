"""Intervals inside intervals: the direct parent of each, met by areas, in crowded ones in dyadic bins.

An interval is cut into the largest stretches of length ``2 ** n`` that begin at multiples of it: two for each power at most,
so that it has about two rows for each doubling of its length, however long it is. A point lies in one stretch of each
length, so it meets every interval around it exactly once; no pair of intervals is made that doesn't share that point.

Edge cases: intervals with a null key or end are in none and hold none; those whose end is before their start hold none; an
interval isn't in itself, nor in one with its ends (``holders`` counts the ones that are longer); an empty table gives an
empty result; repeated rows hold as often as they are there, and each has the same parent; other columns aren't carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths that are told apart: up to 2 ** 40.
POWERS = 40


def dyadic_bins(start: Column, end: Column, powers: int = POWERS) -> Column:
    """The stretches ``{power, at}`` that an interval of whole numbers, both ends in it, is cut into; of more than ``2 ** powers``, several of the longest."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.floor((start + size - 1) / size), F.floor((end + 1) / size)
        size_up = size * 2
        low_up, high_up = F.floor((start + size_up - 1) / size_up) * 2, F.floor((end + 1) / size_up) * 2
        # what the stretches of twice the length leave over on either side
        left = F.when((low < high) & (low_up > low), F.array(low)).otherwise(F.array().cast("array<bigint>"))
        right = F.when((low < high) & (high_up < high) & ((high - 1) >= F.greatest(low_up, low)), F.array(high - 1)).otherwise(F.array().cast("array<bigint>"))
        middle = F.when((k == powers) & (low < high), F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.when(k == powers, middle).otherwise(F.array_distinct(F.concat(left, right))), lambda x: F.struct(k.alias("power"), x.alias("at")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(powers)), at))


def point_bins(point: Column, powers: int) -> Column:
    """The stretches ``{power, at}`` in which a whole number lies, one of each length."""
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return F.transform(F.sequence(F.lit(0), F.lit(powers)), lambda k: F.struct(k.alias("power"), F.floor(point / size(k)).alias("at")))


#: An area is four times as long as all intervals but one in so many; in areas of more intervals, intervals and points meet in bins.
ONE_LONG_IN, MOST_CLOSE = 1000, 200


def _held(intervals: DataFrame, key: str, start: str, end: str, interval_id: str, powers: int = POWERS) -> list[DataFrame]:
    """``(key, area, id, start, end, copies, holder, h_start, h_end)``: intervals and the longer ones of their key that hold them, or nulls.

    Rows are dealt once, by key and area: an interval to the areas of its two ends, where it meets those that begin there;
    all that follows stays in these partitions, but in crowded areas, whose bins are dealt anew. In areas between its ends,
    long ones meet whatever is there. An interval's rows are all in one of the results.
    """
    own = intervals.select(F.col(key).alias("key"), F.col(interval_id).alias("id"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")).filter("key IS NOT NULL AND start <= end")
    bits = dict(own.groupBy(F.length(F.bin(F.col("end") - F.col("start"))).alias("b")).count().collect())
    usual = next((b for b in sorted(bits) if sum(n for other, n in bits.items() if other > b) * ONE_LONG_IN <= sum(bits.values())), 1)
    c = min(usual + 2, powers)
    area = lambda x: F.shiftright(x, c)
    parts = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = own.withColumn("area", F.explode(F.array_distinct(F.array(area("start"), area("end"))))).repartition(parts, "key", "area")
    sides = sides.withColumn("_n", F.count("*").over(Window.partitionBy("key", "area")))
    low, high = F.shiftleft("area", c), F.shiftleft(F.col("area") + 1, c) - 1
    holds = (F.col("h_start") <= F.col("start")) & (F.col("h_end") >= F.col("end")) & (F.col("h_end") - F.col("h_start") > F.col("end") - F.col("start"))
    names = ["key", "area", "id", "start", "end", "copies", "holder", "h_start", "h_end"]
    found, all_points = [], []
    for crowded in (False, True):
        some = sides.filter((F.col("_n") > MOST_CLOSE) == F.lit(crowded)).drop("_n")
        points = some.filter(F.col("area") == area("start")).groupBy("key", "area", "id", "start", "end").agg(F.count("*").alias("copies"))
        holders = some.select(F.col("key").alias("h_key"), F.col("area").alias("h_area"), F.col("id").alias("holder"), F.col("start").alias("h_start"), F.col("end").alias("h_end"))
        met = (F.col("key") == F.col("h_key")) & (F.col("area") == F.col("h_area"))
        all_points.append(points)
        if crowded:
            holders = some.withColumn("h_bin", F.explode(dyadic_bins(F.greatest("start", low) - low, F.least("end", high) - low, c))).select("h_bin", F.col("key").alias("h_key"), F.col("area").alias("h_area"), F.col("id").alias("holder"), F.col("start").alias("h_start"), F.col("end").alias("h_end"))
            points, met = points.withColumn("bin", F.explode(point_bins(F.col("start") - low, c))), met & (F.col("bin") == F.col("h_bin"))
        found.append(points.join(holders, met & holds, "left").select(*names))
    if max(bits, default=0) <= c:
        return found
    points, top = all_points[0].unionByName(all_points[1]), min(powers, max(bits) - c)
    over = own.filter(area("end") - area("start") > 1).select("key", F.col("id").alias("holder"), F.col("start").alias("h_start"), F.col("end").alias("h_end"), F.explode(dyadic_bins(area("start") + 1, area("end") - 1, top)).alias("bin"))
    between = points.select("key", "area").distinct().withColumn("bin", F.explode(point_bins(F.col("area"), top))).join(over, ["key", "bin"]).drop("bin")
    return [found[0].unionByName(found[1]).unionByName(points.join(between, ["key", "area"]).filter(holds).select(*names))]


def holding_pairs(intervals: DataFrame, key: str, start: str, end: str, interval_id: str, powers: int = POWERS) -> DataFrame:
    """``(key, id, start, end, holder, h_start, h_end)`` of intervals and the longer ones of their key that hold them."""
    return reduce(DataFrame.unionByName, _held(intervals, key, start, end, interval_id, powers)).filter("h_start IS NOT NULL").drop("area", "copies")


def nested_intervals(intervals: DataFrame, key: str, start: str, end: str, interval_id: str) -> DataFrame:
    """``(key, id, parent, parents, holders)`` of each interval: the shortest that holds it, if it is the only one of its length.

    ``parents`` are the shortest ones, ``holders`` all.
    """
    own = ["key", "area", "id", "start", "end", "copies"]

    def shortest(pairs: DataFrame) -> DataFrame:
        by_length = pairs.groupBy(*own, (F.col("h_end") - F.col("h_start")).alias("length")).agg(F.count("h_start").alias("n"), F.min("holder").alias("h"))
        return by_length.groupBy(*own).agg(F.min(F.when(F.col("length").isNotNull(), F.struct("length", "n", "h"))).alias("m"), F.sum("n").alias("holders"))

    best = reduce(DataFrame.unionByName, [shortest(pairs) for pairs in _held(intervals, key, start, end, interval_id)])
    best = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    found = best.select("key", "id", F.when(F.col("m.n") == 1, F.col("m.h")).alias("parent"), F.coalesce("m.n", F.lit(0)).cast("long").alias("parents"), F.col("holders").cast("long").alias("holders"))
    in_none = F.col(key).isNull() | ~F.coalesce(F.col(start).cast("long") <= F.col(end).cast("long"), F.lit(False))
    none = intervals.filter(in_none).select(F.col(key).alias("key"), F.col(interval_id).alias("id"), F.lit(None).cast(found.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("parents"), F.lit(0).cast("long").alias("holders"))
    return found.unionByName(none)


def enclosing_callables(lambdas: DataFrame, callables: DataFrame) -> DataFrame:
    """``(lambda_id, method_id, candidates)``: the one callable of its file in whose lines a lambda lies most closely; null if there are none or several.

    ``lambdas(lambda_id, path, line, end_line)``, ``callables(method_id, path, line, end_line)``. A callable on the lambda's own line holds it as well.
    """
    lines = callables.select("path", F.col("method_id").alias("id"), (2 * F.col("line") - 1).alias("start"), (2 * F.col("end_line") + 1).alias("end"), F.lit(False).alias("asks"))
    asked = lambdas.select("path", F.col("lambda_id").alias("id"), (2 * F.col("line")).alias("start"), (2 * F.col("end_line")).alias("end"), F.lit(True).alias("asks"))
    both = lines.unionByName(asked).withColumn("id", F.struct("asks", "id"))
    pairs = holding_pairs(both, "path", "start", "end", "id").filter("id.asks AND NOT holder.asks")
    by_length = pairs.groupBy("id.id", (F.col("h_end") - F.col("h_start")).alias("length")).agg(F.count("*").alias("n"), F.min("holder.id").alias("h"))
    best = by_length.groupBy(F.col("id").alias("lambda_id")).agg(F.min(F.struct("length", "n", "h")).alias("m"))
    return lambdas.select("lambda_id").join(best, "lambda_id", "left").select("lambda_id", F.when(F.col("m.n") == 1, F.col("m.h")).alias("method_id"), F.coalesce("m.n", F.lit(0)).cast("long").alias("candidates"))
