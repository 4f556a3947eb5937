"""JSON documents against JSON schemas: the keywords of a schema are compiled to one expression over a VARIANT.

``violations`` gives the path and the keyword of everything that a document breaks; nothing is parsed in Python. Schemas are
compiled on the driver: local references (``#/$defs/..``) are put in place, a keyword that isn't known, or a reference to
what it stands in, is an error, so that no rule is silently left out.

Edge cases: null texts and texts that are no JSON break the keyword ``json`` at ``$``; an empty schema or ``true`` allows anything; numbers
without a fraction are integers however they are written; lengths are in code points; documents are held by one expression
each, in memory whole; an empty table gives an empty result; other columns, whatever their names, are carried.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relevance import let

BROKEN = "array<struct<path:string,keyword:string>>"
_NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "then", "else", "additionalProperties"}
#: What the types of a schema are in a VARIANT.
KINDS = {"string": ("STRING",), "object": ("OBJECT",), "array": ("ARRAY",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
_TIME = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def _none() -> Column:
    return F.array().cast(BROKEN)


def _broken(path: Column, keyword: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))).cast(BROKEN)


def _if_not(holds: Column, path: Column, keyword: str) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), _none()).otherwise(_broken(path, keyword))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _is(v: Column, name: str) -> Column:
    if name == "integer":
        number = F.try_variant_get(v, "$", "double")
        return _kind(v).isin(*KINDS["number"]) & (number == F.floor(number))
    return _kind(v).isin(*KINDS[name])


def _equals(v: Column, value: object) -> Column:
    if value is None:
        return _kind(v) == "VOID"
    if isinstance(value, bool):
        return _is(v, "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return _is(v, "number") & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return _is(v, "string") & (F.try_variant_get(v, "$", "string") == value)
    return F.to_json(v) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _key(path: Column, name: Column | str) -> Column:
    return F.concat(path, F.lit("."), F.lit(name) if isinstance(name, str) else name)


class _Compiler:
    def __init__(self, root: Mapping | bool) -> None:
        self.root = root

    def resolved(self, ref: str) -> Mapping | bool:
        if not ref.startswith("#/"):
            raise ValueError(f"reference outside of the schema: {ref}")
        at = self.root
        for part in ref[2:].split("/"):
            at = at[part.replace("~1", "/").replace("~0", "~")]
        return at

    def check(self, v: Column, schema: Mapping | bool, path: Column, inside: tuple[str, ...] = ()) -> Column:
        """What ``v``, which is there, breaks of ``schema``."""
        if isinstance(schema, bool):
            return _none() if schema else _broken(path, "false")
        again = lambda s, value=v, at=path: self.check(value, s, at, inside)
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        found = []
        of = lambda name, holds, keyword: found.append(_if_not(~_is(v, name) | F.coalesce(holds, F.lit(False)), path, keyword))
        for keyword, value in schema.items():
            if keyword == "$ref":
                if value in inside:
                    raise ValueError(f"schema refers to itself: {value}")
                found.append(self.check(v, self.resolved(value), path, (*inside, value)))
            elif keyword == "type":
                names = [value] if isinstance(value, str) else value
                found.append(_if_not(reduce(lambda a, b: a | b, [_is(v, n) for n in names]), path, keyword))
            elif keyword == "const":
                found.append(_if_not(_equals(v, value), path, keyword))
            elif keyword == "enum":
                found.append(_if_not(reduce(lambda a, b: a | b, [_equals(v, x) for x in value]), path, keyword))
            elif keyword in ("minLength", "maxLength"):
                of("string", F.length(text) >= value if keyword == "minLength" else F.length(text) <= value, keyword)
            elif keyword == "pattern":
                of("string", text.rlike(value), keyword)
            elif keyword == "format":
                if value != "date-time":
                    raise ValueError(f"unknown format: {value}")
                of("string", text.rlike(_TIME), keyword)
            elif keyword in ("minimum", "maximum"):
                of("number", number >= value if keyword == "minimum" else number <= value, keyword)
            elif keyword in ("minItems", "maxItems", "uniqueItems", "items", "prefixItems"):
                items = F.try_variant_get(v, "$", "array<variant>")
                if keyword == "items":
                    first = len(schema.get("prefixItems", ()))
                    each = lambda xs, s=value, n=first: F.flatten(F.transform(xs, lambda x, i: F.when(i >= n, self.check(x, s, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), inside)).otherwise(_none())))
                    found.append(F.when(_is(v, "array"), let(items, each)).otherwise(_none()))
                elif keyword == "prefixItems":
                    for i, s in enumerate(value):
                        one = lambda x, s=s, i=i: F.when(x.isNotNull(), self.check(x, s, F.concat(path, F.lit(f"[{i}]")), inside)).otherwise(_none())
                        found.append(F.when(_is(v, "array"), let(F.get(items, F.lit(i)), one)).otherwise(_none()))
                elif keyword == "uniqueItems":
                    if value:
                        shown = F.transform(items, lambda x: F.to_json(x))
                        of("array", F.size(F.array_distinct(shown)) == F.size(shown), keyword)
                else:
                    of("array", F.size(items) >= value if keyword == "minItems" else F.size(items) <= value, keyword)
            elif keyword in ("required", "properties", "minProperties", "propertyNames"):
                members = F.try_variant_get(v, "$", "map<string,variant>")
                if keyword == "minProperties":
                    of("object", F.size(members) >= value, keyword)
                elif keyword == "required":
                    if value:
                        missing = F.array_except(F.array(*map(F.lit, value)), F.map_keys(members))
                        told = F.transform(missing, lambda k: F.struct(_key(path, k).alias("path"), F.lit("required").alias("keyword")))
                        found.append(F.when(_is(v, "object"), told).otherwise(_none()))
                elif keyword == "propertyNames":
                    each = lambda names, s=value: F.flatten(F.transform(names, lambda k: F.when(F.size(self.check(F.parse_json(F.to_json(k.cast("variant"))), s, path, inside)) > 0, _broken(_key(path, k), "propertyNames")).otherwise(_none())))
                    found.append(F.when(_is(v, "object"), let(F.map_keys(members), each)).otherwise(_none()))
                else:
                    for name, s in value.items():
                        one = lambda x, s=s, name=name: F.when(x.isNotNull(), self.check(x, s, _key(path, name), inside)).otherwise(_none())
                        found.append(F.when(_is(v, "object"), let(F.try_element_at(members, F.lit(name)), one)).otherwise(_none()))
            elif keyword == "allOf":
                found += [again(s) for s in value]
            elif keyword in ("anyOf", "oneOf"):
                fit = reduce(lambda a, b: a + b, [F.when(F.size(again(s)) == 0, 1).otherwise(0) for s in value])
                found.append(_if_not(fit >= 1 if keyword == "anyOf" else fit == 1, path, keyword))
            elif keyword == "not":
                found.append(_if_not(F.size(again(value)) > 0, path, keyword))
            elif keyword == "if":
                found.append(F.when(F.size(again(value)) == 0, again(schema.get("then", True))).otherwise(again(schema.get("else", True))))
            elif keyword not in _NOTES:
                raise ValueError(f"unknown keyword: {keyword}")
        more = schema.get("additionalProperties", True)
        if more is not True:
            members = F.try_variant_get(v, "$", "map<string,variant>")
            known = list(schema.get("properties", {}))
            other = F.map_filter(members, lambda k, _: ~k.isin(*known) if known else F.lit(True))
            if more is False:
                told = F.transform(F.map_keys(other), lambda k: F.struct(_key(path, k).alias("path"), F.lit("additionalProperties").alias("keyword")))
            else:
                told = F.flatten(F.transform(F.map_entries(other), lambda e: self.check(e["value"], more, _key(path, e["key"]), inside)))
            found.append(F.when(_is(v, "object"), told).otherwise(_none()))
        found = [f.cast(BROKEN) for f in found]
        return F.concat(*found) if len(found) > 1 else found[0] if found else _none()


def violations(text: Column, schema: Mapping | bool) -> Column:
    """``array<struct<path, keyword>>``: everything that a JSON text breaks of a schema, each once, in order of path and keyword."""
    compiler = _Compiler(schema)
    found = let(F.try_parse_json(text), lambda v: F.when(v.isNull(), _broken(F.lit("$"), "json")).otherwise(compiler.check(v, schema, F.lit("$"))))
    return F.array_sort(F.array_distinct(found))


def validated(rows: DataFrame, json_col: str, schema: Mapping | bool, into: str = "violations") -> DataFrame:
    return rows.withColumn(into, violations(F.col(json_col), schema))
