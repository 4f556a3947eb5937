"""From cells of sheets to records, facts and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .storage import saved

_SHEET = ["path", "sheet"]


def scan_records(cells: DataFrame, aliases: DataFrame, least_headers: int = 2) -> DataFrame:
    """``(path, sheet, row, field, value, source_ref, inherited)`` of the records in ``cells(path, sheet, row, col, ref, value)``.

    ``aliases(alias, field)``: names of columns, compared without case and white space. A row with ``least_headers``
    fields among its cells is a header; rows below it, up to the next one, are records of its columns. A row of a label
    and a value beside it, both outside of any header, is context, which every record inherits where its header doesn't
    have the field. References say where a value stands, as ``file#sheet!A5``.
    """
    known = aliases.select(fn.search_text(F.col("alias")).alias("_a"), "field").dropDuplicates(["_a"])
    good = cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "").select(*_SHEET, "row", "col", "ref", F.trim("value").alias("value")).withColumn("_a", fn.search_text(F.col("value")))
    named = saved(good.join(known, "_a", "left"))  # the cells are read four times
    rows = named.groupBy(*_SHEET, "row").agg(F.countDistinct("field").alias("n_fields"), F.count("*").alias("n_cells"), F.min(F.struct("col", "field", "ref")).alias("first"), F.max(F.struct("col", "value", "ref")).alias("last"))
    upto = Window.partitionBy(*_SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    is_header = F.col("n_fields") >= least_headers
    rows = saved(rows.withColumns({"is_header": is_header, "header": F.last(F.when(is_header, F.col("row")), ignorenulls=True).over(upto)}))
    is_context = F.col("header").isNull() & ~F.col("is_header") & (F.col("n_cells") == 2) & F.col("first.field").isNotNull()
    name = F.concat(F.element_at(F.split("path", "/"), -1), F.lit("#"), F.col("sheet"), F.lit("!"))
    context = rows.filter(is_context).groupBy("path", F.col("first.field").alias("field")).agg(F.min(F.struct("sheet", "row", F.col("last.value").alias("value"), F.concat(name, "last.ref").alias("source_ref"))).alias("c"))
    headers = named.filter(F.col("field").isNotNull()).join(rows.filter("is_header").select(*_SHEET, "row"), [*_SHEET, "row"]).select(*_SHEET, F.col("row").alias("header"), "col", "field")
    body = rows.filter(~F.col("is_header") & F.col("header").isNotNull()).select(*_SHEET, "row", "header")
    own = named.drop("field").join(body, [*_SHEET, "row"]).join(headers, [*_SHEET, "header", "col"]).select(*_SHEET, "row", "header", "field", "value", F.concat(name, "ref").alias("source_ref"), F.lit(False).alias("inherited"))
    records = own.select(*_SHEET, "row", "header").distinct()
    handed = records.join(context, "path").join(headers.select(*_SHEET, "header", "field").distinct(), [*_SHEET, "header", "field"], "left_anti")
    handed = handed.select(*_SHEET, "row", "header", "field", "c.value", "c.source_ref", F.lit(True).alias("inherited"))
    return own.unionByName(handed).drop("header")


def record_facts(records: DataFrame, fact_type: str, key_fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Facts ``(stable_key, values, source_refs)`` of ``scan_records`` rows, and ``(path, sheet, row, reason)`` of records that are none.

    A record whose fields have more than one value each conflicts, one without a part of the key has no key; records of
    one key that differ in a value conflict as well, and equal ones are one fact with all references.
    """
    norm = F.regexp_replace(F.lower("value"), r"\s+", " ")
    by_field = records.groupBy(*_SHEET, "row", "field").agg(F.min("value").alias("value"), F.countDistinct(norm).alias("n"), F.collect_set("source_ref").alias("refs"))
    per = by_field.groupBy(*_SHEET, "row").agg(F.max("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("values"), F.array_sort(F.flatten(F.collect_list("refs"))).alias("source_refs"))
    key = fn.stable_key(fact_type, *[F.element_at("values", f) for f in key_fields])
    per = per.withColumns({"stable_key": key, "reason": F.when(F.col("n") > 1, "conflicting_field").when(key.isNull(), "missing_key")})
    values = F.to_json("values")
    keyed = per.filter("reason is null").groupBy("stable_key").agg(F.countDistinct(values).alias("n"), F.first("values").alias("values"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_refs")))).alias("source_refs"))
    clash = per.filter("reason is null").join(keyed.filter("n > 1").select("stable_key"), "stable_key", "left_semi").withColumn("reason", F.lit("conflicting_records"))
    bad = per.filter("reason is not null").unionByName(clash.select(*per.columns)).select(*_SHEET, "row", "reason")
    return keyed.filter("n = 1").select("stable_key", "values", "source_refs"), bad


def fact_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(stable_key, change_type, field, before, after, source_refs)``: a row for each field of a fact that came, went or changed.

    References and the order of fields make no change.
    """
    b = before.select("stable_key", F.col("values").alias("b"), F.col("source_refs").alias("b_refs"))
    a = after.select("stable_key", F.col("values").alias("a"), F.col("source_refs").alias("a_refs"))
    both = b.join(a, "stable_key", "full_outer")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").otherwise("modified")
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    refs = lambda m: F.coalesce(m, F.array().cast("array<string>"))
    each = both.select("stable_key", kind.alias("change_type"), F.explode(F.array_union(keys("b"), keys("a"))).alias("field"), "b", "a", F.array_sort(F.array_union(refs("b_refs"), refs("a_refs"))).alias("source_refs"))
    at = lambda m: F.element_at(m, F.col("field"))
    return each.select("stable_key", "change_type", "field", at("b").alias("before"), at("a").alias("after"), "source_refs").filter(~F.col("before").eqNullSafe(F.col("after")))


def document_diff(before: DataFrame, after: DataFrame, aliases: DataFrame, fact_type: str, key_fields: Sequence[str]) -> DataFrame:
    """``fact_changes`` of two versions of a document's cells: records, facts by stable key, and their difference."""
    facts = [record_facts(scan_records(cells, aliases), fact_type, key_fields)[0] for cells in (before, after)]
    return fact_changes(*facts)


def a1(row: Column, col: Column) -> Column:
    """The reference of a cell, as ``AB12``: columns are numbers in letters, without a zero."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: i)  # 26 ** 14 is beyond 64 bits
    start = F.struct(col.cast("long").alias("left"), F.lit("").alias("letters"))
    step = lambda acc, _: F.when(acc["left"] < 1, acc).otherwise(F.struct(F.floor((acc["left"] - 1) / 26).alias("left"), F.concat(F.chr(65 + (acc["left"] - 1) % 26), acc["letters"]).alias("letters")))
    return F.concat(F.aggregate(digits, start, step, lambda acc: acc["letters"]), row.cast("string"))
