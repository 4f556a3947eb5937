"""JSON paths and condition operators that fail closed, with a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(doc: Column, path: str) -> Column:
    """``(present, is_null, value)`` of a path like ``$.a.b[0]`` in a JSON text; null apart from absent."""
    found = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    return F.struct(
        found.isNotNull().alias("present"),
        F.coalesce(F.is_variant_null(found), F.lit(False)).alias("is_null"),
        F.try_variant_get(F.try_parse_json(doc), path, "string").alias("value"),
    )


def json_kind(doc: Column, path: str) -> Column:
    """The type of what a path leads to: null, text, number, truth, other; null if there is nothing."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
    return (
        F.when(kind == "VOID", "null").when(kind == "STRING", "text").when(kind == "BOOLEAN", "truth")
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)"), "number").when(kind.isNotNull(), "other")
    )


def _at(doc: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), path, "variant")


def json_count(doc: Column, path: str) -> Column:
    """How many there are at a path: a whole number itself, members of a list or an object, code points of a text; else null."""
    found = _at(doc, path)
    kind = F.regexp_extract(F.schema_of_variant(found), "^[A-Z]+", 0)
    return (
        F.when(kind == "BIGINT", F.try_variant_get(found, "$", "long")).when(kind == "ARRAY", F.size(F.try_variant_get(found, "$", "array<variant>")).cast("long"))
        .when(kind == "OBJECT", F.size(F.try_variant_get(found, "$", "map<string,variant>")).cast("long")).when(kind == "STRING", F.length(F.try_variant_get(found, "$", "string")).cast("long"))
    )


def condition(doc: Column, path: str, operator: str, *operands: float | str) -> Column:
    """``(passed, reason)`` of one condition on a JSON text.

    A missing path or a value of the wrong type never passes; truth values are not numbers. ``count_equals`` counts what is at the
    path (see ``json_count``); ``equals_path`` compares with what stands at another path, its operand.
    """
    kind, value = json_kind(doc, path), json_value(doc, path)["value"]
    number = F.when(kind == "number", value.cast("double"))
    text_operands = [F.lit(str(o)) for o in operands]
    if operator == "exists":
        passed, fits = kind.isNotNull(), F.lit(True)
    elif operator in ("gt", "gte", "lt", "lte", "between"):
        fits, a = kind == "number", float(operands[0])
        passed = {
            "gt": number > a, "gte": number >= a, "lt": number < a, "lte": number <= a,
            "between": number.between(a, float(operands[-1])),
        }[operator]
    elif operator == "contains":
        fits, passed = kind == "text", F.contains(value, text_operands[0])
    elif operator == "count_equals":
        size = json_count(doc, path)
        fits, passed = size.isNotNull(), size == int(operands[0])
    elif operator == "equals_path":
        other = json_kind(doc, str(operands[0]))
        fits = other.isNotNull()
        passed = F.coalesce(F.to_json(_at(doc, path)) == F.to_json(_at(doc, str(operands[0]))), F.lit(False)) | ((kind == "number") & (other == "number") & (number == json_value(doc, str(operands[0]))["value"].cast("double")))
    elif operator in ("equals", "not_equals", "in"):
        fits = kind.isNotNull()
        same = F.lit(False)
        for o, t in zip(operands, text_operands):
            same = same | ((number == float(o)) if isinstance(o, (int, float)) and not isinstance(o, bool) else ((kind == "text") & (value == t)))
        same = F.coalesce(same, F.lit(False))
        passed = ~same if operator == "not_equals" else same
    else:
        raise ValueError(f"unknown operator {operator}")
    reason = F.when(kind.isNull(), "missing_path").when(~fits, "wrong_type").when(~passed, "not_satisfied").otherwise("satisfied")
    return F.struct((reason == "satisfied").alias("passed"), reason.alias("reason"))
