"""Struts and Tiles configuration and JSP pages as tables, and the inheritance of page definitions.

``files(path, text)`` of any kind go in; what a file is, its root element says. XML is read by Spark's own reader. A file that
declares entities or an inner document type isn't read but reported, as is one that isn't well-formed.

Definitions inherit by pointer jumping: each holds the definition that it extends and what it sets itself; a round gives it what
that one sets and the one which that one extends, so that chains of n definitions take a logarithm of n rounds. What is set nearer wins.

Edge cases: null and empty texts are no configuration; a definition whose name several files give is ``ambiguous_definition``, one
that extends an unknown one ``missing_parent``, one on or behind a cycle ``cycle``, all without a page; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import saved

_FORWARD = "ARRAY<STRUCT<_name: STRING, _path: STRING>>"
_SCHEMAS = {
    "struts-config": f"""`form-beans` STRUCT<`form-bean`: ARRAY<STRUCT<_name: STRING, _type: STRING>>>, `global-forwards` STRUCT<forward: {_FORWARD}>,
        `action-mappings` STRUCT<action: ARRAY<STRUCT<_path: STRING, _type: STRING, _name: STRING, _input: STRING, _forward: STRING, _include: STRING, _parameter: STRING, forward: {_FORWARD}>>>, _corrupt STRING""",
    "tiles-definitions": "definition ARRAY<STRUCT<_name: STRING, _extends: STRING, _path: STRING, _page: STRING, _template: STRING, put: ARRAY<STRUCT<_name: STRING, _value: STRING, _content: STRING>>>>, _corrupt STRING",
    "web-app": "servlet ARRAY<STRUCT<`servlet-name`: STRING, `servlet-class`: STRING>>, `servlet-mapping` ARRAY<STRUCT<`servlet-name`: STRING, `url-pattern`: ARRAY<STRING>>>, _corrupt STRING",
}


def documents(files: DataFrame, kind: str) -> DataFrame:
    """``(path, x, reason)`` of the files whose root element is ``kind``; ``x`` is null where there is a reason."""
    root = F.regexp_extract("text", r"^\s*(?:<\?[^>]*>|<!--(?s:.*?)-->|<![^>\[]*(?:\[(?s:.*?)\]\s*)?>|\s)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    own = files.filter(root == kind).select("path", "text")
    unsafe = F.col("text").rlike(r"(?i)<!ENTITY|<!DOCTYPE[^>]*\[")
    plain = F.regexp_replace(F.regexp_replace("text", r"(?i)<!DOCTYPE[^>]*>", ""), r"<\?[^>]*\?>", "")
    read = own.withColumn("x", F.when(~unsafe, F.from_xml(plain, _SCHEMAS[kind], {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})))
    reason = F.when(unsafe, "unsafe_xml").when(F.col("x").isNull() | F.col("x._corrupt").isNotNull(), "malformed_xml")
    return read.select("path", F.when(reason.isNull(), F.col("x")).alias("x"), reason.alias("reason"))


def actions(files: DataFrame) -> DataFrame:
    """``(path, action, type, form, input, target)`` of action mappings; ``target`` is where one goes without a class, or a forwarding class by its parameter."""
    rows = documents(files, "struts-config").select("path", F.explode("x.action-mappings.action").alias("a"))
    by_class = F.when(F.regexp_extract("a._type", r"([^.]+)$", 1).isin("ForwardAction", "IncludeAction"), F.col("a._parameter"))
    return rows.select("path", action_path(F.col("a._path")).alias("action"), F.col("a._type").alias("type"), F.col("a._name").alias("form"), F.col("a._input").alias("input"), F.coalesce("a._forward", "a._include", by_class).alias("target"))


def forms(files: DataFrame) -> DataFrame:
    """``(path, form, type)``."""
    return documents(files, "struts-config").select("path", F.explode("x.form-beans.form-bean").alias("f")).select("path", F.col("f._name").alias("form"), F.col("f._type").alias("type"))


def forwards(files: DataFrame) -> DataFrame:
    """``(path, action, name, target)``: of an action, or of all where ``action`` is null."""
    rows = documents(files, "struts-config").filter("x IS NOT NULL")
    local = rows.select("path", F.explode("x.action-mappings.action").alias("a")).select("path", action_path(F.col("a._path")).alias("action"), F.explode("a.forward").alias("f"))
    shared = rows.select("path", F.lit(None).cast("string").alias("action"), F.explode("x.global-forwards.forward").alias("f"))
    return local.unionByName(shared).select("path", "action", F.col("f._name").alias("name"), F.col("f._path").alias("target"))


def action_path(value: Column) -> Column:
    """An action's path: one slash before it, no ending ``.do`` and no query."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(value, r"[?#].*$", ""), r"^/+|\.do$", ""))


def endpoints(files: DataFrame) -> DataFrame:
    """``(action, endpoint)``: action paths in the patterns under which the action servlet answers."""
    apps = documents(files, "web-app").filter("x IS NOT NULL")
    names = apps.select("path", F.inline(F.transform("x.servlet", lambda s: F.struct(s["servlet-name"].alias("name"), s["servlet-class"].alias("of"))))).filter(F.col("of").endswith(".ActionServlet"))
    maps = apps.select("path", F.explode("x.servlet-mapping").alias("m")).select("path", F.col("m.servlet-name").alias("name"), F.explode("m.url-pattern").alias("pattern"))
    patterns = maps.join(names, ["path", "name"], "left_semi").select(F.trim("pattern").alias("pattern")).distinct()
    ending = F.when(F.col("pattern").startswith("*."), F.substring("pattern", 2, 1 << 20))
    shaped = patterns.select(F.regexp_replace(F.when(F.col("pattern").endswith("/*"), F.col("pattern")), r"/\*$", "").alias("head"), ending.alias("ending")).filter("ending IS NOT NULL OR head IS NOT NULL")
    one = shaped.agg(F.collect_set(F.struct(F.coalesce("head", F.lit("")).alias("head"), F.coalesce("ending", F.lit("")).alias("ending"))).alias("patterns"))  # one row
    return actions(files).select("action").distinct().crossJoin(one).select("action", F.explode("patterns").alias("p")).select("action", F.concat("p.head", "action", "p.ending").alias("endpoint")).distinct()


def definitions(files: DataFrame) -> DataFrame:
    """``(path, name, parent, page, puts)`` of page definitions."""
    rows = documents(files, "tiles-definitions").select("path", F.explode("x.definition").alias("d"))
    puts = F.transform(F.coalesce("d.put", F.array()), lambda p: F.struct(p["_name"].alias("key"), F.coalesce(p["_value"], p["_content"]).alias("value")))
    last = F.aggregate(puts, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    return rows.select("path", F.col("d._name").alias("name"), F.col("d._extends").alias("parent"), F.coalesce("d._path", "d._page", "d._template").alias("page"), F.when(F.size(puts) > 0, last).otherwise(F.create_map().cast("map<string,string>")).alias("puts"))


def inherited_definitions(defs: DataFrame) -> DataFrame:
    """``(name, page, puts, depth, reason)`` of ``defs(name, parent, page, puts)``: with all that they inherit; ``depth`` counts those extended."""
    counted = defs.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct("parent", "page", "puts")).alias("d"))
    ambiguous = counted.filter("n > 1").select("name", F.lit(None).cast("string").alias("page"), F.lit(None).cast("map<string,string>").alias("puts"), F.lit(None).cast("long").alias("depth"), F.lit("ambiguous_definition").alias("reason"))
    own = saved(counted.filter("n = 1").select("name", F.col("d.parent").alias("up"), F.col("d.page").alias("page"), F.col("d.puts").alias("puts"), F.col("d.parent").isNotNull().cast("long").alias("depth")))
    total, round_no = own.count(), 0
    open_ = own.filter("up IS NOT NULL")
    while not open_.isEmpty() and (1 << round_no) <= 2 * total:  # a chain without a cycle ends by then
        above = own.select(F.col("name").alias("up"), F.col("up").alias("_up"), F.col("page").alias("_page"), F.col("puts").alias("_puts"), F.col("depth").alias("_depth"))
        j = open_.join(above, "up", "left")
        known = F.col("_depth").isNotNull()
        merged = F.map_concat(F.map_filter("_puts", lambda k, _: ~F.array_contains(F.map_keys("puts"), k)), F.col("puts"))
        moved = j.select("name", F.when(known, F.col("_up")).otherwise(F.lit("\x00")).alias("up"), F.when(known, F.coalesce("page", "_page")).otherwise(F.col("page")).alias("page"), F.when(known, merged).otherwise(F.col("puts")).alias("puts"), F.when(known, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"))
        own = saved(own.filter("up IS NULL OR up = '\\u0000'").unionByName(moved))
        open_ = own.filter("up IS NOT NULL AND up <> '\\u0000'")
        round_no += 1
    missing = F.col("up") == "\x00"
    reason = F.when(missing, "missing_parent").when(F.col("up").isNotNull(), "cycle")
    clear = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return own.select("name", clear("page"), clear("puts"), clear("depth"), reason.alias("reason")).unionByName(ambiguous)


#: Tags of pages that lead elsewhere, with the attribute that says where, and its kind.
PAGE_TAGS = (
    ("html:form", "action", "action"), ("html:link", "action", "action"), ("html:link", "forward", "forward"), ("html:link", "page", "route"), ("html:rewrite", "action", "action"),
    ("html:rewrite", "forward", "forward"), ("logic:forward", "name", "forward"), ("tiles:insert", "definition", "definition"), ("tiles:insertDefinition", "name", "definition"),
    ("jsp:forward", "page", "route"), ("jsp:include", "page", "route"), ("form", "action", "route"), ("a", "href", "route"),
)


def page_targets(pages: DataFrame) -> DataFrame:
    """``(path, tag, kind, target)`` of where JSP pages lead; a target with an expression is ``dynamic``."""
    text = F.regexp_replace("text", r"(?s)<%--.*?--%>|<!--.*?-->", "")
    marked = F.split(F.regexp_replace(text, r"<(?=[A-Za-z])", "\x01<"), "\x01")  # each tag begins a part
    parts = pages.select("path", F.posexplode(marked).alias("k", "part"))
    tag = F.regexp_extract("part", r"^<([A-Za-z][\w:.-]*)", 1)
    attribute = lambda name: F.regexp_extract("part", rf"(?s)^<[^>]*?\s{name}\s*=\s*(?:\"([^\"]+)\"|'([^']+)')", 1)
    other = lambda name: F.regexp_extract("part", rf"(?s)^<[^>]*?\s{name}\s*=\s*'([^']+)'", 1)
    value = lambda name: F.when(attribute(name) != "", attribute(name)).otherwise(other(name))
    found = F.filter(F.array(*[F.when(tag == t, F.struct(F.lit(k).alias("kind"), value(a).alias("target"))) for t, a, k in PAGE_TAGS]), lambda x: x.isNotNull() & (x["target"] != ""))
    rows = parts.filter(tag != "").select("path", tag.alias("tag"), F.inline(found))
    return rows.select("path", "tag", F.when(F.col("target").rlike(r"[$#]\{|<%"), "dynamic").otherwise(F.col("kind")).alias("kind"), "target")
