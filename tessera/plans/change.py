"""Unresolved evidence, calls, verdicts and document diffs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import assembly, code_graph, intervals, java_source, progress, records, revisions, schemas, unresolved, verdicts
from ..sources import webflow
from ..streaming import diagnostics, leases, state
from .registry import Tables, query


def _text(*parts: object) -> Column:
    """Columns (names) and literals (other values, in one-item tuples) as one string."""
    return F.concat(*[F.lit(str(p[0])) if isinstance(p, tuple) else F.col(p).cast("string") for p in parts])


@query("record_diff", """
WITH v AS (SELECT 'part:' || p_partkey AS k, p_partkey AS id, p_name AS name, p_size::VARCHAR AS size, p_brand AS brand FROM part),
b AS (SELECT * FROM v WHERE id % 7 <> 0), a AS (SELECT k, id, CASE WHEN id % 11 = 0 THEN name || ' new' ELSE name END AS name, size, brand FROM v WHERE id % 5 <> 0),
f AS (SELECT coalesce(b.k, a.k) AS stable_key, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'deleted' ELSE 'modified' END AS change_type,
             unnest([{'f': 'id', 'b': b.id::VARCHAR, 'a': a.id::VARCHAR}, {'f': 'name', 'b': b.name, 'a': a.name}, {'f': 'size', 'b': b.size, 'a': a.size}, {'f': 'brand', 'b': b.brand, 'a': a.brand}]) AS x
      FROM b FULL JOIN a ON a.k = b.k)
SELECT stable_key, change_type, x.f AS field, x.b AS before, x.a AS after FROM f WHERE x.b IS DISTINCT FROM x.a
""")
def record_diff(t: Tables) -> DataFrame:
    """Two versions of sheets (one a hundred parts) with a context row, a header and a row a part."""
    head = {1: "Part No", 2: "NAME ", 3: "Size"}

    def cells(keep: str, name: Column) -> DataFrame:
        p = t.part.filter(keep).select("p_partkey", name.alias("n"), "p_size", "p_brand")
        sheet = F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 100).cast("string"))
        row = (F.col("p_partkey") % 100 + 4).cast("int")
        body = F.array(*[F.struct(row.alias("row"), F.lit(c).alias("col"), v.cast("string").alias("value")) for c, v in ((1, F.col("p_partkey")), (2, F.col("n")), (3, F.col("p_size")))])
        top = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("value")) for r, c, v in ((1, 1, F.lit("brand name")), (1, 2, F.col("p_brand")), *[(3, c, F.lit(h)) for c, h in head.items()])])
        rows = p.select(F.concat(sheet, F.lit(".xlsx")).alias("path"), F.lit("Parts").alias("sheet"), F.explode(F.concat(body, top)).alias("c")).select("path", "sheet", "c.*").distinct()
        return rows.withColumn("ref", records.a1(F.col("row"), F.col("col")))

    spark = t.spark
    aliases = spark.createDataFrame([("part no", "id"), ("Name", "name"), ("SIZE", "size"), ("Brand Name", "brand")], "alias string, field string")
    later = F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name"))
    diff = records.document_diff(cells("p_partkey % 7 <> 0", F.col("p_name")), cells("p_partkey % 5 <> 0", later), aliases, "part", ["id"])
    return diff.select("stable_key", "change_type", "field", "before", "after")


@query("unresolved_report", """
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unresolved:table:' || upper(event_type) WHEN 1 THEN 'external:lib' || user_id % 3 WHEN 2 THEN 'unresolved:call:svc.' || event_type || '/' || user_id % 3
             ELSE 'unresolved:endpoint:http:GET:/u/' || user_id % 9 || '/' || event_type END AS target FROM events),
s AS (SELECT DISTINCT event_type AS n FROM events),
c AS (SELECT event_id, target, CASE event_id % 4 WHEN 0 THEN ['table-' || substring(lower(target), 18)]
             WHEN 2 THEN CASE WHEN target LIKE '%/0' THEN [] WHEN target LIKE '%/1' THEN ['m1-' || split_part(substring(target, 21), '/', 1)] ELSE ['m2a-' || split_part(substring(target, 21), '/', 1), 'm2b-' || split_part(substring(target, 21), '/', 1)] END
             WHEN 3 THEN CASE WHEN target LIKE '%/click' THEN ['any-click'] WHEN target LIKE '%/error' THEN ['get-error'] ELSE [] END ELSE [] END AS c FROM e)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'data_table' WHEN 1 THEN 'generic_relation' WHEN 2 THEN 'call_target' ELSE 'endpoint_route' END AS category,
       CASE WHEN event_id % 4 = 1 THEN 'external_reference_unverified' WHEN len(c) > 1 THEN 'target_ambiguous' WHEN len(c) = 1 THEN 'unresolved_reference' ELSE 'target_definition_missing' END AS reason,
       array_to_string(c, ',') AS candidates FROM c
""")
def unresolved_report(t: Tables) -> DataFrame:
    """Events as open edges to tables, libraries, methods and endpoints that carry the event types' names."""
    kind = F.col("event_id") % 4
    target = (
        F.when(kind == 0, F.concat(F.lit("unresolved:table:"), F.upper("event_type"))).when(kind == 1, F.concat(F.lit("external:lib"), (F.col("user_id") % 3).cast("string")))
        .when(kind == 2, F.concat(F.lit("unresolved:call:svc."), "event_type", F.lit("/"), (F.col("user_id") % 3).cast("string")))
        .otherwise(F.concat(F.lit("unresolved:endpoint:http:GET:/u/"), (F.col("user_id") % 9).cast("string"), F.lit("/"), "event_type"))
    )
    e = t.events.select(
        F.col("event_id").alias("edge_id"), F.lit("uses").alias("edge_type"), F.lit("f").alias("from_ref"), target.alias("to_ref"), F.lit("unresolved").alias("resolution_status"), F.lit("x").alias("extractor"),
        F.lit("1").alias("profile_version"), F.lit("p").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("static_edge_ref"),
    )
    names = t.events.select(F.col("event_type").alias("n")).distinct()
    made = [("table-", "db_table", "table:", ""), ("m1-", "method", "", "(int a)"), ("m2a-", "method", "", "(int a, Map<K, V> b)"), ("m2b-", "method", "", "(int a, int b)")]
    symbols = names.select(F.explode(F.array(*[F.struct(_text((p,), "n").alias("symbol_id"), F.lit(k).alias("symbol_type"), F.col("n").alias("name"), _text((a,), "n", (z,)).alias("signature")) for p, k, a, z in made])).alias("s")).select("s.*")
    endpoints = t.spark.createDataFrame([("any-click", "ANY", "/u/{id}/click"), ("get-error", "GET", "/u/{id}/error"), ("post-signup", "POST", "/u/{id}/signup"), ("long", "GET", "/u/{id}")], "endpoint_ref string, method string, template string")
    out = unresolved.unresolved_report(e, symbols, endpoints)
    return out.select(F.col("edge_id").alias("event_id"), "category", "reason", F.array_join("candidates", ",").alias("candidates"))


@query("route_reconcile", """
WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, o_custkey % 20 AS seg, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS src, o_custkey FROM orders),
c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 4 <> 1),
x AS (SELECT o.*, c_nationkey, CASE WHEN c_nationkey IS NULL THEN 0 WHEN src % 6 = 0 THEN 0 WHEN src % 6 = 2 THEN 2 ELSE 1 END AS open FROM o LEFT JOIN c ON src = c_custkey),
r AS (SELECT id, src, seg, CASE WHEN src IS NULL THEN 'missing_source_route_ref' WHEN c_nationkey IS NULL THEN 'source_route_not_found' WHEN open = 0 THEN 'source_route_not_unresolved' WHEN open > 1 THEN 'source_route_ambiguous'
             WHEN method <> CASE WHEN c_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END THEN 'method_mismatch'
             WHEN seg < 5 THEN 'endpoint_not_found' WHEN seg < 8 THEN 'endpoint_ambiguous' ELSE 'resolved_unique' END AS reason, method FROM x)
SELECT id, CASE WHEN reason = 'resolved_unique' THEN 'resolved' ELSE 'unresolved' END AS status, reason, CASE WHEN reason = 'resolved_unique' THEN 'e' || seg END AS endpoint FROM r
""")
def route_reconcile(t: Tables) -> DataFrame:
    """Orders as observations, customers as routes with none, one or two open edges, endpoints by segment."""
    o = t.orders.select(
        F.col("o_orderkey").alias("observation_id"), F.when(F.col("o_orderkey") % 3 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/s/"), (F.col("o_custkey") % 20).cast("string"), F.lit("/x")).alias("path"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("source_route_ref"),
    )
    c = t.customer.filter("c_custkey % 4 <> 1")
    routes = c.select(F.col("c_custkey").alias("route_ref"), F.when(F.col("c_nationkey") % 2 == 0, "GET").otherwise("POST").alias("route_method"))
    n = F.when(F.col("c_custkey") % 6 == 0, 0).when(F.col("c_custkey") % 6 == 2, 2).otherwise(1)
    edges = c.filter("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("from_ref"), F.explode(F.sequence(F.lit(1), n)).alias("edge_id"))
    rows = [(f"e{s}", "ANY", f"/s/{s}/x") for s in range(5, 20)] + [(f"f{s}", m, f"/s/{s}/{{id}}") for s in (5, 6, 7) for m in ("GET", "POST")]
    endpoints = t.spark.createDataFrame(rows, "endpoint_ref string, method string, template string")
    out = unresolved.reconcile_routes(o, routes, edges, endpoints)
    return out.select(F.col("observation_id").alias("id"), "status", "reason", F.col("endpoint_ref").alias("endpoint"))


@query("call_resolution", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS owner, l_suppkey % 8 AS recv, l_linenumber % 3 AS arity, l_quantity::INT % 5 AS m FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, owner, arity, m, CASE recv WHEN 0 THEN owner WHEN 1 THEN (owner + 1) % 50 WHEN 2 THEN (owner + 2) % 50 WHEN 3 THEN NULL WHEN 4 THEN -1 ELSE (owner + recv) % 50 END AS pos FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN pos = -1 THEN 'external' WHEN pos IS NULL OR (pos + m + arity) % 4 = 0 OR (pos + m + arity) % 4 = 1 THEN 'unresolved' ELSE 'resolved' END AS status,
       CASE WHEN pos >= 0 AND (pos + m + arity) % 4 >= 2 THEN pos || '.m' || m || '/' || arity || '-0' END AS target,
       CASE WHEN pos IS NULL OR pos = -1 THEN 0 WHEN (pos + m + arity) % 4 = 0 THEN 0 WHEN (pos + m + arity) % 4 = 1 THEN 2 ELSE 1 END AS candidates FROM x
""")
def call_resolution(t: Tables) -> DataFrame:
    """Lines as calls in fifty classes: on itself, on a field, on a type by name, on an unknown name, on an imported library."""
    o, r = F.col("l_partkey") % 50, F.col("l_suppkey") % 8
    fqn = lambda n: F.concat(F.lit("app.T"), n.cast("string"))
    receiver = (
        F.when(r == 0, F.lit("this")).when(r == 1, F.lit("this.next")).when(r == 2, F.lit("after")).when(r == 3, F.lit("nobody")).when(r == 4, F.lit("Library")).otherwise(F.concat(F.lit("T"), ((o + r) % 50).cast("string")))
    )
    calls = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("call_id"), fqn(o).alias("owner"), receiver.alias("receiver"), F.concat(F.lit("m"), (F.col("l_quantity").cast("int") % 5).cast("string")).alias("name"), (F.col("l_linenumber") % 3).alias("arity"))
    n = t.spark.range(50).select(F.col("id").cast("int").alias("n"))
    types = n.select(fqn(F.col("n")).alias("fqn"), F.concat(F.lit("T"), F.col("n").cast("string")).alias("simple"), F.lit("app").alias("package"))
    fields = n.select(fqn(F.col("n")).alias("owner"), F.explode(F.array(F.struct(F.lit("next").alias("name"), F.concat(F.lit("T"), ((F.col("n") + 1) % 50).cast("string"), F.lit("<X>")).alias("type")), F.struct(F.lit("after").alias("name"), fqn((F.col("n") + 2) % 50).alias("type")))).alias("f")).select("owner", "f.*")
    imports = n.select(fqn(F.col("n")).alias("owner"), F.lit("Library").alias("simple"), F.lit("lib.Library").alias("fqn"))
    kind = (F.col("n") + F.col("m") + F.col("a")) % 4
    methods = n.crossJoin(t.spark.range(15).select((F.col("id") % 5).cast("int").alias("m"), F.floor(F.col("id") / 5).cast("int").alias("a"))).filter(kind != 0)  # fifteen rows
    methods = methods.select(fqn(F.col("n")).alias("owner"), _text(("m",), "m").alias("name"), F.col("a").alias("arity"), F.lit("T0").alias("returns"), F.explode(F.sequence(F.lit(0), F.when(kind == 1, 1).otherwise(0))).alias("k"), "n", "m")
    methods = methods.select("owner", "name", "arity", "returns", F.concat(F.col("n").cast("string"), F.lit("."), "name", F.lit("/"), F.col("arity").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("method_id"))
    out = unresolved.resolve_calls(calls, methods, fields, types, imports)
    return out.select("call_id.*", "status", "target", F.col("candidate_count").alias("candidates"))


@query("source_calls", """
WITH p AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS top FROM part),
t AS (SELECT k, top, unnest([{'name': 'go', 'steps': 0}, {'name': 'go', 'steps': 1}, {'name': 'stop', 'steps': 2}, {'name': 'f', 'steps': -1}, {'name': 'helper', 'steps': -1}, {'name': 'go', 'steps': -1}], recursive := true) FROM p),
x AS (SELECT *, k + steps + 1 AS place FROM t)
SELECT k, name, greatest(steps, 0) AS steps, CASE WHEN steps < 0 THEN 'unresolved' WHEN place <= top THEN 'resolved' ELSE 'external' END AS status,
       CASE WHEN steps >= 0 AND place <= top THEN 'p' || place % 20 || '.C' || place || CASE name WHEN 'go' THEN '#go(int,Map<String,List<Integer>>)' ELSE '#stop()' END END AS target
FROM x
""")
def source_calls(t: Tables) -> DataFrame:
    """Parts as Java files with a field of the next part's class: its fields, methods, calls and chains out of the text, resolved."""
    k = F.col("p_partkey")
    text = F.concat(
        F.format_string("package p%d;\n\nimport p%d.C%d;\n\n/* { ( */ class C%d {\n", k % 20, (k + 1) % 20, k + 1, k), F.format_string("    private C%d next; int size = %d, width;\n", k + 1, F.col("p_size")),
        F.format_string("    C%d go(int a, Map<String, List<Integer>> b) { return next; }\n", k + 1), F.format_string("    void run() {\n        String s = \"%s } ((\"; // %s {\n", F.col("p_name"), F.col("p_type")),
        F.lit("        next.go(1, null).go(f(2, 3), s).stop();\n        helper(y -> y.go(1, 2)); size += 1;\n    }\n    void stop() { }\n}\n"),
    )
    source = java_source.Source(t.part.select(k.cast("string").alias("path"), text.alias("text")))
    calls = source.calls()
    out = unresolved.resolve_calls(calls, source.methods(), source.fields(), source.types, source.imports())
    out = out.select("call_id", "status", "target").join(calls.select("call_id", "path", "name", F.size("chain").alias("steps")), "call_id")
    return out.select(F.col("path").cast("long").alias("k"), "name", "steps", "status", "target")


@query("bracket_pairs", r"""
WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '[^()\[\]{}]', '', 'g'), '') AS b FROM documents),
p AS (SELECT doc_id, len(x) AS gap, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[()\[\]{}]') AS l FROM documents))),
w AS (SELECT doc_id, i, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) + i - 1 AS at FROM p),
o AS (SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM c WHERE len(b) > 0 AND b[1] <> ''),
l AS (SELECT doc_id, i, b, b IN ('(', '[', '{') AS opens, sum(CASE WHEN b IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM o),
m AS (SELECT doc_id, i, b, opens, lead(b) OVER q AS b2, lead(i) OVER q AS i2 FROM (SELECT *, CASE WHEN opens THEN after ELSE after + 1 END AS level FROM l) WINDOW q AS (PARTITION BY doc_id, level ORDER BY i))
SELECT m.doc_id, a.at::BIGINT AS open_at, z.at::BIGINT AS close_at, m.b || m.b2 AS pair
FROM m JOIN w AS a ON a.doc_id = m.doc_id AND a.i = m.i JOIN w AS z ON z.doc_id = m.doc_id AND z.i = m.i2
WHERE m.opens AND m.b || m.b2 IN ('()', '[]', '{}')
""")
def bracket_pairs(t: Tables) -> DataFrame:
    """The brackets of all documents that belong together, by running depths."""
    files = t.documents.select(F.col("doc_id").alias("path"), "text")
    rows = java_source.tokens(files, r"[()\[\]{}]|[^()\[\]{}]+").filter(F.length("token") == 1).filter(F.col("token").isin(*"()[]{}"))
    rows = java_source.matched(rows)
    ends = rows.filter(F.col("token").isin(")", "]", "}") & F.col("partner").isNotNull()).select("path", F.col("partner").alias("j"), F.col("at").alias("close_at"), F.col("token").alias("closes"))
    return rows.join(ends, ["path", "j"]).select(F.col("path").alias("doc_id"), F.col("at").alias("open_at"), "close_at", F.concat("token", "closes").alias("pair"))


@query("nested_intervals", """
WITH l AS (SELECT l_orderkey % 300 AS k, l_orderkey * 10 + l_linenumber AS id, l_partkey AS s, l_partkey + (CAST(l_quantity AS BIGINT) % 10) * (l_suppkey % 12) AS e FROM lineitem),
h AS (SELECT a.k, a.id, a.s, a.e, b.id AS h, b.e - b.s AS n FROM (SELECT DISTINCT * FROM l) a JOIN l b ON a.k = b.k AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s),
m AS (SELECT k, id, s, e, min(n) AS least, count(*) AS holders FROM h GROUP BY ALL),
p AS (SELECT m.k, m.id, m.s, m.e, m.holders, count(*) AS parents, min(h.h) AS parent FROM m JOIN h ON h.k = m.k AND h.id = m.id AND h.s = m.s AND h.e = m.e AND h.n = m.least GROUP BY ALL)
SELECT l.k, l.id, CASE WHEN parents = 1 THEN parent ELSE -1 END AS parent, coalesce(parents, 0) AS parents, coalesce(holders, 0) AS holders
FROM l LEFT JOIN p ON p.k = l.k AND p.id = l.id AND p.s = l.s AND p.e = l.e
""")
def nested_intervals(t: Tables) -> DataFrame:
    """Lines as stretches of parts in three hundred files, each with the shortest one around it."""
    rows = t.lineitem.select(
        (F.col("l_orderkey") % 300).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.col("l_partkey").alias("s"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long") % 10 * (F.col("l_suppkey") % 12)).alias("e"),
    )
    return intervals.nested_intervals(rows, "k", "s", "e", "i").withColumnRenamed("key", "k").withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query("inherited_definitions", """
WITH RECURSIVE d AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 500 = 498 THEN p_partkey + 1 WHEN p_partkey % 500 = 499 THEN p_partkey - 1 WHEN p_partkey < 3 THEN NULL WHEN p_partkey % 101 = 50 THEN -1 ELSE p_partkey // 3 END AS up,
  CASE WHEN p_size % 3 = 0 OR p_partkey < 3 THEN p_size END AS page, CASE WHEN p_size % 4 = 0 THEN p_brand END AS body FROM part),
r AS (SELECT k, page, body, 0::BIGINT AS depth FROM d WHERE up IS NULL
      UNION ALL SELECT d.k, coalesce(d.page, r.page), coalesce(d.body, r.body), r.depth + 1 FROM d JOIN r ON d.up = r.k),
m AS (SELECT k FROM d WHERE up IS NOT NULL AND up NOT IN (SELECT k FROM d) UNION ALL SELECT d.k FROM d JOIN m ON d.up = m.k)
SELECT d.k, r.page::VARCHAR AS page, r.body, coalesce(r.depth, -1) AS depth, CASE WHEN r.k IS NOT NULL THEN NULL WHEN d.k IN (SELECT k FROM m) THEN 'missing_parent' ELSE 'cycle' END AS reason FROM d LEFT JOIN r ON r.k = d.k
""")
def inherited_definitions(t: Tables) -> DataFrame:
    """Parts as page definitions that extend one another; some extend nothing known, some each other."""
    k = F.col("p_partkey")
    up = F.when(k % 500 == 498, k + 1).when(k % 500 == 499, k - 1).when(k < 3, None).when(k % 101 == 50, -1).otherwise(F.expr("p_partkey div 3"))
    body = F.when(F.col("p_size") % 4 == 0, F.create_map(F.lit("body"), F.col("p_brand"))).otherwise(F.create_map().cast("map<string,string>"))
    defs = t.part.select(k.cast("string").alias("name"), up.cast("string").alias("parent"), F.when((F.col("p_size") % 3 == 0) | (k < 3), F.col("p_size").cast("string")).alias("page"), body.alias("puts"))
    out = webflow.inherited_definitions(defs)
    return out.select(F.col("name").cast("long").alias("k"), "page", F.col("puts")["body"].alias("body"), F.coalesce("depth", F.lit(-1)).alias("depth"), "reason")


#: What the properties of events have to be.
EVENT_SCHEMA = {
    "type": "object", "required": ["k", "unit"], "additionalProperties": False,
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90, "not": {"enum": [50, 60]}}, "unit": {"type": "string"}},
    "if": {"properties": {"k": {"maximum": 20}}}, "then": {"properties": {"k": {"const": 15}}},
}


@query("schema_violations", """
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
b AS (SELECT event_id, unnest([CASE WHEN k < 10 THEN '$.k minimum' END, CASE WHEN k > 90 THEN '$.k maximum' END, CASE WHEN k IN (50, 60) THEN '$.k not' END, CASE WHEN k <= 20 AND k <> 15 THEN '$.k const' END, '$.unit required']) AS v FROM e)
SELECT event_id, string_agg(v, ';' ORDER BY v) AS violations FROM b WHERE v IS NOT NULL GROUP BY event_id
""")
def schema_violations(t: Tables) -> DataFrame:
    """What the properties of events break of a schema."""
    out = schemas.validated(t.events.select("event_id", "props"), "props", EVENT_SCHEMA)
    return out.select("event_id", F.array_join(F.transform("violations", lambda v: F.concat_ws(" ", v["path"], v["keyword"])), ";").alias("violations"))


@query("revision_state", """
WITH RECURSIVE o AS (SELECT user_id AS c, event_id AS op, event_id % 5 = 2 AND event_id % 3 > 0 AS undo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS field, value FROM events),
b AS (SELECT *, CASE WHEN op % 7 = 3 AND n > 1 THEN -1 ELSE coalesce(sum((NOT (op % 7 = 3 AND n > 1))::INT) OVER (PARTITION BY c ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS base FROM o),
r AS (SELECT c, 0::BIGINT AS n, 0::BIGINT AS version, []::BIGINT[] AS stack FROM (SELECT DISTINCT c FROM b)
      UNION ALL
      SELECT b.c, b.n, CASE WHEN b.base = r.version AND (NOT undo OR len(stack) > 0) THEN version + 1 ELSE version END,
             CASE WHEN b.base <> r.version THEN stack WHEN NOT undo THEN list_append(stack, op) WHEN len(stack) > 0 THEN stack[1:len(stack) - 1] ELSE stack END
      FROM r JOIN b ON b.c = r.c AND b.n = r.n + 1),
f AS (SELECT c, version, unnest(stack) AS op FROM (SELECT c, arg_max(version, n) AS version, arg_max(stack, n) AS stack FROM r GROUP BY c))
SELECT f.c AS case_id, field, arg_max(value, f.op) AS value, max(f.op) AS op_id, any_value(version) AS version FROM f JOIN b ON b.c = f.c AND b.op = f.op GROUP BY f.c, field
""")
def revision_state(t: Tables) -> DataFrame:
    """Events as edits and undos of users' cases; some of them against an old version."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = t.events.withColumn("n", place.cast("long"))
    late = (F.col("event_id") % 7 == 3) & (F.col("n") > 1)
    before = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    base = F.when(late, -1).otherwise(F.coalesce(F.sum((~late).cast("long")).over(before), F.lit(0)))
    operations = e.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("op_id"), F.when((F.col("event_id") % 5 == 2) & (F.col("event_id") % 3 > 0), "undo").otherwise("edit").alias("kind"),
        base.alias("base_version"), F.col("event_type").alias("field"), "value",
    )
    return revisions.revision_state(operations)


@query("lease_history")
def lease_history(t: Tables) -> DataFrame:
    """Events as those of a queue: runs by user, tasks and claims by id, two active tasks a run at most. Its order is a state machine's, beyond SQL."""
    kinds = F.array(*map(F.lit, ("enqueue", "claim", "claim", "heartbeat", "claim", "release", "complete")))
    e = t.events.select(
        F.col("user_id").alias("run_id"), "event_id", (F.xxhash64("event_id") % 4).alias("task_id"), kinds[F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(7)).cast("int")].alias("kind"),
        F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("claim_id"), F.col("ts").alias("at"), F.lit(86400).cast("long").alias("lease_seconds"), F.lit(2).cast("long").alias("max_attempts"),
    )
    return leases.lease_history(e, 2)


@query("known_diagnostics", """
WITH n AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events),
e AS (SELECT user_id, event_id, ts AS received, ts + to_minutes((event_id % 14 - 5)::BIGINT) AS observed FROM events, n WHERE ts <= now AND ts >= now - INTERVAL 15 MINUTE),
m AS (SELECT user_id, max((received, event_id)) AS m FROM e WHERE observed <= received + INTERVAL 5 MINUTE GROUP BY user_id)
SELECT user_id AS consumer, m[2] AS report FROM m ORDER BY m[1] DESC, m[2] DESC LIMIT 32
""")
def known_diagnostics(t: Tables) -> DataFrame:
    """Events as reports of users, as they are known an hour before the last one."""
    now = t.events.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).cast("string")).first()[0]
    reports = t.events.select(F.col("user_id").alias("consumer_id"), F.col("event_id").alias("report_id"), F.col("ts").alias("received_at"), (F.col("ts") + F.make_interval(mins=(F.col("event_id") % 14 - 5).cast("int"))).alias("observed_at"))
    return diagnostics.known_at(reports, now).select(F.col("consumer_id").alias("consumer"), F.col("report_id").alias("report"))


@query("test_file_bindings", """
WITH e AS (SELECT l_orderkey AS f, l_partkey AS t, l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS c FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT CASE WHEN f % 2 = 1 THEN t % 100 ELSE f % 100 END AS production, CASE WHEN f % 2 = 1 THEN f % 100 ELSE t % 100 END AS test, id, c FROM e WHERE (f % 2 = 1) <> (t % 2 = 1))
SELECT production, test, id, c FROM x QUALIFY row_number() OVER (PARTITION BY production, test ORDER BY CASE c WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id) = 1
""")
def test_file_bindings(t: Tables) -> DataFrame:
    e = t.lineitem.filter("l_returnflag = 'R'").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.lit("tests").alias("edge_type"), F.lit("resolved").alias("resolution_status"), F.col("l_orderkey").alias("from_ref"), F.col("l_partkey").alias("to_ref"),
        F.when(F.col("l_linenumber") % 3 == 0, "high").when(F.col("l_linenumber") % 3 == 1, "low").otherwise("medium").alias("confidence"),
    )
    refs = e.select(F.col("from_ref").alias("ref")).unionByName(e.select(F.col("to_ref").alias("ref"))).distinct()
    owners = refs.select("ref", (F.col("ref") % 100).alias("file_id"), F.when(F.col("ref") % 2 == 1, "test").otherwise("source").alias("role"))
    out = unresolved.test_bindings(e, owners, "snapshot")
    return out.select(F.col("production_file").alias("production"), F.col("test_file").alias("test"), F.col("edge_id").alias("id"), F.col("confidence").alias("c"))


@query("preferred_definitions", """
WITH c AS (SELECT p_type AS name, p_partkey AS id, p_size > 48 AS is_def FROM part WHERE p_size > 40)
SELECT n.p_type AS name, CASE WHEN count(*) FILTER (is_def) = 1 THEN min(id) FILTER (is_def) WHEN count(*) FILTER (is_def) = 0 AND count(id) = 1 THEN min(id) END AS target,
       CASE WHEN count(*) FILTER (is_def) > 0 THEN count(*) FILTER (is_def) ELSE count(id) END AS candidate_count
FROM (SELECT DISTINCT p_type || p_brand AS k, p_type, p_brand FROM part) n LEFT JOIN c ON c.name = n.p_type GROUP BY n.p_type
""".replace("SELECT DISTINCT p_type || p_brand AS k, p_type, p_brand FROM part", "SELECT DISTINCT p_type FROM part"))
def preferred_definitions(t: Tables) -> DataFrame:
    c = t.part.filter("p_size > 40").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_size") > 48).alias("is_def"))
    return unresolved.preferred_targets(t.part.select(F.col("p_type").alias("name")), c, "name", "id", "is_def")


@query("scoped_forwards", """
WITH a AS (SELECT DISTINCT CASE WHEN l_orderkey % 9 <> 0 THEN l_suppkey % 40 END AS scope, l_linenumber AS name FROM lineitem),
s AS (SELECT s_suppkey % 40 AS scope, s_nationkey % 7 + 1 AS name, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS t FROM supplier GROUP BY 1, 2),
g AS (SELECT n_nationkey % 9 + 1 AS name, count(DISTINCT n_nationkey::BIGINT) AS n, min(n_nationkey::BIGINT) AS t FROM nation GROUP BY 1)
SELECT a.scope, a.name, CASE WHEN coalesce(s.n, g.n, 0) = 1 THEN CASE WHEN s.n IS NOT NULL THEN s.t ELSE g.t END END AS target, coalesce(s.n, g.n, 0) AS candidate_count
FROM a LEFT JOIN s ON s.scope = a.scope AND s.name = a.name LEFT JOIN g ON g.name = a.name
""")
def scoped_forwards(t: Tables) -> DataFrame:
    asked = t.lineitem.select(F.when(F.col("l_orderkey") % 9 != 0, F.col("l_suppkey") % 40).alias("scope"), F.col("l_linenumber").alias("name"))
    own = t.supplier.select((F.col("s_suppkey") % 40).alias("scope"), (F.col("s_nationkey") % 7 + 1).alias("name"), F.col("s_suppkey").alias("target"))
    shared = t.nation.select((F.col("n_nationkey") % 9 + 1).alias("name"), F.col("n_nationkey").cast("long").alias("target"))
    return unresolved.scoped_targets(asked, own, shared, "scope", "name", "target")


@query("action_methods", """
WITH m AS (SELECT o_custkey AS owner, CASE o_orderkey % 4 WHEN 0 THEN 'execute' WHEN 1 THEN 'perform' ELSE 'other' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 2 END AS arity, o_orderkey AS id FROM orders),
g AS (SELECT owner, count(DISTINCT id) FILTER (arity = 4) AS n4, min(id) FILTER (arity = 4) AS m4, count(DISTINCT id) AS n, min(id) AS m FROM m WHERE name <> 'other' GROUP BY owner)
SELECT c_custkey AS owner, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN n4 = 1 THEN m4 WHEN n4 = 0 AND n = 1 THEN m END END AS method_id, CASE WHEN n4 > 0 THEN n4 ELSE coalesce(n, 0) END AS candidate_count
FROM customer LEFT JOIN g ON owner = c_custkey
""")
def action_methods(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    m = t.orders.select(F.col("o_custkey").alias("owner"), F.when(k % 4 == 0, "execute").when(k % 4 == 1, "perform").otherwise("other").alias("name"), F.when(k % 3 == 0, 4).otherwise(2).alias("arity"), k.alias("method_id"))
    return unresolved.action_methods(t.customer.select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 5 == 0).alias("dispatches")), m)


@query("endpoint_product", """
WITH p AS (SELECT p_partkey AS owner, CASE WHEN p_size % 4 = 0 THEN [''] ELSE ['/' || p_type || '/', p_brand] END AS cp, CASE WHEN p_size % 3 = 0 THEN [''] ELSE ['/a', 'b/', '/a'] END AS mp, CASE WHEN p_size % 5 = 0 THEN ['ANY'] ELSE ['GET', 'POST'] END AS hm FROM part),
x AS (SELECT owner, unnest(cp) AS c, mp, hm FROM p), y AS (SELECT owner, c, unnest(mp) AS m, hm FROM x), z AS (SELECT owner, c, m, unnest(hm) AS method FROM y)
SELECT DISTINCT owner, method, '/' || array_to_string(list_filter([trim(c, '/'), trim(m, '/')], lambda s: s <> ''), '/') AS path FROM z
""")
def endpoint_product(t: Tables) -> DataFrame:
    some = lambda every, *values: F.when(F.col("p_size") % every != 0, F.array(*values)).otherwise(F.array().cast("array<string>"))
    c = t.part.select(F.col("p_partkey").alias("owner"), some(4, F.concat(F.lit("/"), "p_type", F.lit("/")), F.col("p_brand")).alias("class_paths"), some(3, *map(F.lit, ("/a", "b/", "/a"))).alias("method_paths"), some(5, F.lit("GET"), F.lit("POST")).alias("http_methods"))
    return unresolved.endpoint_product(c).select("owner", "method", "path")


@query("field_accesses", """
WITH l AS (SELECT l_orderkey AS method, l_suppkey % 10 AS owner, l_linenumber AS name, CASE l_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '+=' WHEN 2 THEN '++' ELSE '.' END AS op FROM lineitem),
u AS (SELECT * FROM l WHERE method * 10 + name NOT IN (SELECT o_orderkey * 10 + o_orderkey % 7 + 1 FROM orders) AND name <= 5)
SELECT DISTINCT method, owner * 10 + name AS field, unnest(CASE op WHEN '=' THEN ['writes'] WHEN '.' THEN ['reads'] ELSE ['reads', 'writes'] END) AS access FROM u
""")
def field_accesses(t: Tables) -> DataFrame:
    p = F.col("l_partkey") % 4
    used = t.lineitem.select(F.col("l_orderkey").alias("method_id"), (F.col("l_suppkey") % 10).alias("owner"), F.col("l_linenumber").alias("name"), F.when(p == 0, "=").when(p == 1, "+=").when(p == 2, "++").otherwise(".").alias("operator"))
    fields = used.select("owner", "name").distinct().filter("name <= 5").withColumn("field_id", F.col("owner") * 10 + F.col("name"))
    local_names = t.orders.select(F.col("o_orderkey").alias("method_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("name"))
    return unresolved.field_accesses(used, fields, local_names).select(F.col("method_id").alias("method"), F.col("field_id").alias("field"), "access")


@query("claim_verdicts", """
WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'code_test' WHEN 1 THEN 'command_evidence' WHEN 2 THEN 'canonical_evidence' ELSE 'plan' END AS kind, o_custkey AS k FROM orders)
SELECT id, CASE kind WHEN 'code_test' THEN k % 3 <> 0 AND k % 5 <> 0 WHEN 'command_evidence' THEN k % 5 <> 0 WHEN 'canonical_evidence' THEN k % 2 = 0 ELSE k % 11 <> 0 END AS valid FROM c
""")
def claim_verdicts(t: Tables) -> DataFrame:
    """Orders as claims on sources that carry the customer's key; some of these aren't allowed."""
    kind = F.when(F.col("o_orderkey") % 4 == 0, "code_test").when(F.col("o_orderkey") % 4 == 1, "command_evidence").when(F.col("o_orderkey") % 4 == 2, "canonical_evidence").otherwise("plan")
    k = F.array(F.col("o_custkey").cast("string"))
    some = lambda *kinds: F.when(kind.isin(*kinds), k).otherwise(F.array().cast("array<string>"))
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"), kind.alias("kind"), some("code_test").alias("test_files"), some("code_test", "command_evidence").alias("commands"), some("canonical_evidence").alias("artifacts"), some("plan").alias("components"))
    keys = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    allowed = lambda rule: keys.filter(rule).select(F.col("k").cast("string").alias("ref"))
    out = verdicts.claim_verdicts(claims, allowed("k % 3 <> 0"), allowed("k % 5 <> 0"), allowed("k % 2 = 0"), allowed("k % 11 <> 0"))
    return out.select(F.col("claim_id").alias("id"), "valid")


@query("executable_cases", """
WITH l AS (SELECT l_orderkey AS k, list(DISTINCT 's' || l_linenumber) AS steps, list(DISTINCT 's' || l_linenumber) FILTER (l_quantity > 3) AS mapped, list(DISTINCT 's' || l_linenumber) FILTER (l_quantity > 3 AND l_discount < 0.1) AS asserted,
           list(DISTINCT 'd' || l_suppkey % 30) AS data, bool_or(l_suppkey % 30 = 7) AS missing FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id FROM orders JOIN l ON k = o_orderkey
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND list_has_all(coalesce(mapped, []), steps) AND list_has_all(coalesce(asserted, []), steps) AND NOT missing AND o_orderkey % 13 <> 0
""")
def executable_cases(t: Tables) -> DataFrame:
    """Orders as cases, their lines as steps with data; one data set doesn't exist, some cases lack a covered tuple."""
    data, step = F.concat(F.lit("d"), (F.col("l_suppkey") % 30).cast("string")), F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(data).alias("data_refs"), F.collect_set(step).alias("step_ids"))
    o = t.orders.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") != "P", "ui").otherwise("api").alias("level"), F.when(F.col("o_orderpriority") != "5-LOW", "browser").otherwise("manual").alias("mode"), F.array(F.lit("c1"), F.lit("c2")).alias("criterion_refs"), F.array(F.lit("ok")).alias("expected_results"))
    cases = o.join(lines, "case_id")
    steps = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.lit("ui").alias("channel"), F.when(F.col("l_quantity") > 3, "click").alias("action"), F.when(F.col("l_discount") < 0.1, 1).otherwise(0).alias("observations"), F.lit(1).alias("postconditions"), F.array(step).alias("step_refs"), F.array(data).alias("data_refs"))
    data_sets = t.spark.range(30).filter("id <> 7").select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("data_id"))
    covered = t.lineitem.select(F.col("l_orderkey").alias("case_id"), data.alias("data_id"), F.explode(F.array(F.lit("c1"), F.when(F.col("l_orderkey") % 13 != 0, F.lit("c2")))).alias("criterion")).distinct()
    return verdicts.executable_cases(cases, steps, data_sets, covered)


@query("test_results", """
WITH f AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS failed, bool_or(l_returnflag = 'A') AS open FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 AND f.k IS NULL THEN 'blocked' WHEN o_orderkey % 2 = 0 AND failed THEN 'failed' WHEN o_orderkey % 2 = 0 AND open THEN 'blocked'
       WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 4 = 0 THEN 'blocked' WHEN o_custkey % 4 = 1 THEN 'failed' WHEN o_custkey % 4 = 2 THEN 'passed' ELSE 'blocked' END ELSE 'passed' END AS status
FROM orders LEFT JOIN f ON f.k = o_orderkey
""")
def test_results(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    flows = t.lineitem.filter("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("case_id"), F.when(flag == "R", "failed").when(flag == "A", "running").otherwise("passed").alias("status"), F.array(F.lit("e")).alias("evidence_refs"))
    cases = t.orders.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "ui").otherwise("unit").alias("level"), (F.col("o_orderkey") % 2 == 0).alias("data_required"))
    ui = t.orders.filter("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_custkey") % 4 == 1, "failed").when(F.col("o_custkey") % 4 == 2, "passed").otherwise("odd").alias("status"), F.array(F.lit("u")).alias("evidence_refs"))
    edit = t.spark.createDataFrame([(True, ["r1"], True)], "committed boolean, result_refs array<string>, passed boolean")
    return verdicts.test_results(cases, flows, ui, edit).select("case_id", "status")


@query("version_deltas", """
WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice::INT::VARCHAR AS total FROM orders WHERE o_orderkey % 6 <> 0),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS status, (o_totalprice::INT + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR AS total FROM orders WHERE o_orderkey % 9 <> 0),
x AS (SELECT coalesce(b.k, a.k) AS k, unnest([{'f': 'status', 'b': b.status, 'a': a.status}, {'f': 'total', 'b': b.total, 'a': a.total}]) AS d FROM b FULL JOIN a ON a.k = b.k)
SELECT k, d.f AS field, d.b AS before, d.a AS after FROM x WHERE d.b IS DISTINCT FROM d.a
""".replace("o_totalprice::INT", "floor(o_totalprice)::BIGINT"))
def version_deltas(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    o = t.orders.select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").cast("long").alias("total"))
    later = o.withColumns({"status": F.when(F.col("k") % 4 == 0, "F").otherwise(F.col("status")), "total": F.col("total") + F.when(F.col("k") % 10 == 0, 1).otherwise(0)})
    return verdicts.version_deltas(o.filter("k % 6 <> 0"), later.filter("k % 9 <> 0"), "k", ["status", "total"])


@query("confirmation_faults", """
WITH i AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS i FROM lineitem),
d AS (SELECT l_orderkey AS r, l_linenumber + CASE WHEN l_partkey % 50 = 0 THEN 90 ELSE 0 END AS i, sum(CASE WHEN l_suppkey % 40 = 0 THEN 2 ELSE 1 END) AS n FROM lineitem WHERE l_partkey % 60 <> 1 GROUP BY 1, 2)
SELECT coalesce(i.r, d.r) AS report, coalesce(i.i, d.i) AS item, CASE WHEN d.r IS NULL THEN 'missing' WHEN i.r IS NULL THEN 'unknown' ELSE 'repeated' END AS fault
FROM i FULL JOIN d ON i.r = d.r AND i.i = d.i WHERE d.r IS NULL OR i.r IS NULL OR n > 1
""")
def confirmation_faults(t: Tables) -> DataFrame:
    i = t.lineitem.select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("item"))
    d = t.lineitem.filter("l_partkey % 60 <> 1").select(F.col("l_orderkey").alias("report"), (F.col("l_linenumber") + F.when(F.col("l_partkey") % 50 == 0, 90).otherwise(0)).alias("item"), F.explode(F.sequence(F.lit(1), F.when(F.col("l_suppkey") % 40 == 0, 2).otherwise(1))).alias("n"))
    return verdicts.confirmation_faults(i, d, "report", "item")


@query("rag_readiness", """
WITH c AS (SELECT o_custkey AS k, bool_or(o_orderpriority = '1-URGENT') AS rejected, bool_or(o_orderpriority = '2-HIGH') AS review, count(*) AS n, sum(o_orderkey % 30 = 0)::BIGINT AS holes FROM orders GROUP BY 1)
SELECT c_custkey AS case_id, CASE WHEN k IS NULL OR holes > 0 OR rejected THEN 'blocked' WHEN review THEN 'needs_review' ELSE 'ready' END AS status FROM customer LEFT JOIN c ON k = c_custkey
""")
def rag_readiness(t: Tables) -> DataFrame:
    o = t.orders.withColumn("case_id", F.col("o_custkey"))
    changes = o.select("case_id", F.when(F.col("o_orderpriority") == "1-URGENT", "rejected").when(F.col("o_orderpriority") == "2-HIGH", "needs_review").otherwise("accepted").alias("review_status"))
    index = o.select("case_id", F.lit(1).alias("targets"), F.when(F.col("o_orderkey") % 30 == 0, 0).otherwise(1).alias("indexed"))
    return verdicts.rag_readiness(t.customer.select(F.col("c_custkey").alias("case_id")), changes, index).select("case_id", "status")


@query("worker_view", """
WITH w AS (SELECT user_id, max(ts) AS seen, bool_or(event_type = 'error' AND value > 95) AS stopped FROM events GROUP BY 1),
c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' AND ts + INTERVAL 72 HOUR > TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT w.user_id AS worker_id, NOT stopped AND seen > TIMESTAMP '2024-01-28' AND seen <= TIMESTAMP '2024-01-29' AS live, coalesce(n, 0) AS active_claims FROM w LEFT JOIN c USING (user_id)
""")
def worker_view(t: Tables) -> DataFrame:
    e = t.events.withColumn("worker_id", F.col("user_id"))
    workers = e.groupBy("worker_id").agg(F.max("ts").alias("last_seen"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 95)).alias("stopped"))
    claims = e.filter(F.col("ts") <= F.lit("2024-01-29").cast("timestamp")).select("worker_id", (F.col("event_type") == "view").alias("released"), (F.col("ts") + F.expr("INTERVAL 72 HOURS")).alias("expires_at"))
    return verdicts.worker_view(workers, claims, "2024-01-29", 86_400)


@query("profile_matches", """
WITH s AS (SELECT o_custkey AS doc, o_orderpriority AS p, max(o_orderkey % 4) AS score FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
b AS (SELECT doc, max(score) FILTER (score >= 2) AS best, max(score) AS top FROM s GROUP BY 1),
n AS (SELECT s.doc, count(*) AS n, min(p) AS p FROM s JOIN b ON b.doc = s.doc AND s.score = b.best AND s.score >= 2 GROUP BY 1)
SELECT b.doc AS document, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 OR top > 0 THEN 'review' ELSE 'ignored' END AS outcome, CASE WHEN n = 1 THEN p END AS profile, coalesce(best, top) AS score FROM b LEFT JOIN n ON n.doc = b.doc
""")
def profile_matches(t: Tables) -> DataFrame:
    s = t.orders.filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("profile")).agg(F.max(F.col("o_orderkey") % 4).alias("score"))
    return verdicts.match_profiles(s.withColumn("automatic", F.col("score") >= 2))


@query("learning_coverage", """
WITH s AS (SELECT o_custkey AS doc, o_orderpriority AS p, max(o_orderkey % 4) AS score FROM orders GROUP BY 1, 2),
b AS (SELECT doc, max(score) AS best FROM s WHERE score >= 2 GROUP BY 1),
u AS (SELECT s.doc, min(p) AS p FROM s JOIN b ON b.doc = s.doc AND s.score = b.best GROUP BY 1 HAVING count(*) = 1),
a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN 'none' ELSE coalesce(u.p, '3-MEDIUM') END AS p, u.p AS sole FROM customer LEFT JOIN u ON u.doc = c_custkey),
r AS (SELECT k, CASE WHEN p IS NULL THEN 'assignment_missing' WHEN p = 'none' THEN 'profile_unknown' WHEN sole IS NULL OR p <> sole THEN 'no_unique_match' WHEN k % 9 = 0 THEN 'no_facts' END AS reason FROM a)
SELECT k AS sample_id, reason IS NULL AS covered, reason FROM r
""")
def learning_coverage(t: Tables) -> DataFrame:
    """Customers as samples, matched with order priorities as profiles; most are assigned what matches alone."""
    m = t.orders.groupBy(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("profile")).agg(F.max(F.col("o_orderkey") % 4).alias("score")).withColumns({"automatic": F.col("score") >= 2, "variant": F.lit("v")})
    alone = verdicts.match_profiles(m.select(F.col("sample_id").alias("document"), "profile", "score", "automatic")).filter("outcome = 'matched'").select(F.col("document").alias("sample_id"), F.col("profile").alias("p"))
    samples = t.customer.select(F.col("c_custkey").alias("sample_id"))
    k = F.col("sample_id")
    a = samples.join(alone, "sample_id", "left").filter("sample_id % 8 <> 0").select("sample_id", F.when(k % 8 == 1, "none").otherwise(F.coalesce("p", F.lit("3-MEDIUM"))).alias("profile"), F.lit("v").alias("variant"))
    profiles = t.orders.select(F.col("o_orderpriority").alias("profile")).distinct()
    facts = samples.select("sample_id", F.when(k % 9 == 0, 0).otherwise(2).alias("n"))
    return verdicts.learning_coverage(samples, a, profiles, m, facts)


@query("failure_view", """
WITH f AS (SELECT user_id % 20 AS project, user_id AS run_id, ts, CASE WHEN event_type = 'error' THEN 'command' ELSE 'search_index' END AS category FROM events WHERE event_type = 'error' OR (event_type = 'purchase' AND value > 80))
SELECT project, category, CASE category WHEN 'command' THEN 'code_and_test' ELSE 'requirement' END AS stage, count(*) AS failures, count(DISTINCT run_id) AS runs, max(ts) AS last_at FROM f GROUP BY 1, 2
""")
def failure_view(t: Tables) -> DataFrame:
    e = t.events.select((F.col("user_id") % 20).alias("project"), F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_type", "value")
    kinds = {"command": e.filter("event_type = 'error'"), "search_index": verdicts.scoped(e, event_type="purchase").filter("value > 80")}
    return verdicts.failure_view(kinds, {"command": "code_and_test", "search_index": "requirement"})


@query("cell_bindings", """
WITH r AS (SELECT s_suppkey AS ref, s_nationkey % 5 AS sheet, 0 AS place, s_suppkey % 40 AS r1, s_suppkey % 40 + 1 AS r2 FROM supplier UNION ALL SELECT s_suppkey, s_nationkey % 5, 1, s_suppkey % 40 + 20, s_suppkey % 40 + 21 FROM supplier),
c AS (SELECT p_partkey AS node, p_size % 5 AS sheet, p_partkey % 97 AS row, p_size AS col FROM part WHERE p_size % 3 = 0),
h AS (SELECT ref, node, min(place) AS f FROM r JOIN c ON r.sheet = c.sheet AND row BETWEEN r1 AND r2 AND col BETWEEN 1 AND 9 GROUP BY 1, 2),
g AS (SELECT ref, count(*) AS n, min(node) AS a, count(*) FILTER (f = 0) AS n0, min(node) FILTER (f = 0) AS a0 FROM h GROUP BY 1)
SELECT s_suppkey AS ref, CASE WHEN n = 1 THEN a WHEN n0 = 1 THEN a0 END AS node_id, CASE WHEN n IS NULL THEN 'no_node' WHEN n = 1 OR n0 = 1 THEN 'bound' ELSE 'ambiguous' END AS reason FROM supplier LEFT JOIN g ON ref = s_suppkey
""")
def cell_bindings(t: Tables) -> DataFrame:
    at = (F.col("s_suppkey") % 40).cast("int")
    places = F.array(*[F.struct(F.lit(n).alias("place"), (at + 20 * n).alias("row1"), (at + 20 * n + 1).alias("row2")) for n in (0, 1)])
    refs = t.supplier.select(F.col("s_suppkey").alias("ref"), F.lit("d").alias("document"), (F.col("s_nationkey") % 5).alias("sheet"), F.inline(places), F.lit(1).alias("col1"), F.lit(9).alias("col2"))
    cells = t.part.filter("p_size % 3 = 0").select(F.col("p_partkey").alias("node_id"), F.lit("d").alias("document"), (F.col("p_size") % 5).alias("sheet"), (F.col("p_partkey") % 97).alias("row"), F.col("p_size").alias("col"))
    return verdicts.bind_cells(refs, cells)


@query("context_items", """
WITH n AS (SELECT o_custkey AS package, o_orderkey AS node, o_orderkey % 3 AS section, o_orderkey % 7 AS ordinal, o_orderstatus AS summary, substring(o_orderpriority, 1, 1) || o_orderkey AS content,
           least(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 99 END, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 99 END, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 99 END) AS rank FROM orders),
i AS (SELECT package, section, min(rank) AS rank, string_agg(summary || ': ' || content, ' | ' ORDER BY ordinal, node) AS details, string_agg(node::VARCHAR, ',' ORDER BY ordinal, node) AS refs FROM n WHERE rank < 99 GROUP BY 1, 2)
SELECT package, section AS section_id, CASE rank WHEN 1 THEN 'direct_change' WHEN 3 THEN 'rag_candidate' ELSE 'parent' END AS reason, refs, ceil(length(details) * 0.25)::BIGINT AS tokens,
       sum(ceil(length(details) * 0.25)) OVER (PARTITION BY package ORDER BY rank, section) <= 12 AS within_budget FROM i
""")
def context_items(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    key = [F.col("o_custkey").alias("package"), k.alias("node_id")]
    nodes = t.orders.select(*key, (k % 3).alias("section_id"), (k % 7).alias("ordinal"), F.col("o_orderstatus").alias("summary"), F.concat(F.substring("o_orderpriority", 1, 1), k.cast("string")).alias("content"))
    why = F.array(F.when(F.col("o_totalprice") > 150000, "direct_change"), F.when(k % 4 == 0, "rag_candidate"), F.when(k % 2 == 0, "parent"))
    out = verdicts.context_items(nodes, t.orders.select(*key, F.explode(why).alias("reason")), budget=12)
    return out.select("package", "section_id", "reason", F.array_join(F.transform("evidence_refs", lambda x: x.cast("string")), ",").alias("refs"), "tokens", "within_budget")


@query("signature_arities", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS arity, CASE p_size % 3 WHEN 0 THEN 'reads' WHEN 1 THEN 'writes' END AS operation FROM part
""")
def signature_arities(t: Tables) -> DataFrame:
    size = F.col("p_size") % 4
    text = F.when(size == 0, "( )").when(size == 1, "(Map<K, List<Set<A<B<C, D>, E>>>> m)").when(size == 2, "(int[] a, Map<String, Integer> b)").otherwise("(A a, B<C, D> b, E... e)")
    name = F.when(F.col("p_size") % 3 == 0, "findBy").when(F.col("p_size") % 3 == 1, "SaveAll").otherwise("orphan")
    return t.part.select("p_partkey", fn.signature_arity(F.concat("p_brand", text)).alias("arity"), code_graph.database_operation(F.concat(name, "p_type")).alias("operation"))


@query("cell_places", "SELECT p_partkey, p_size AS row, (p_partkey % 700 + 1)::INT AS col FROM part")
def cell_places(t: Tables) -> DataFrame:
    """References of cells, written and read back."""
    ref = records.a1(F.col("p_size"), F.col("p_partkey") % 700 + 1)
    return t.part.select("p_partkey", fn.a1_row_col(ref).alias("c")).select("p_partkey", "c.row", "c.col")


@query("preferred_edges", """
SELECT id, origin FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey * 100000 + l_partkey AS origin,
  row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_suppkey * 100000 + l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1
""")
def preferred_edges(t: Tables) -> DataFrame:
    e = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("origin")).distinct()
    return code_graph.preferred_edges(e, "origin").withColumnRenamed("edge_id", "id")


@query("replayed_events", "SELECT event_id, user_id, event_type FROM events")
def replayed_events(t: Tables) -> DataFrame:
    """The log, with a third of its events delivered again, once each."""
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    return state.replay_safe(e.unionByName(e.filter("event_id % 3 = 0")), "event_id", "ts").drop("ts")


@query("shown_stages", """
SELECT o_custkey AS k, o_orderkey AS stage, CASE WHEN max(o_orderstatus <> 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'waiting' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS shown_state FROM orders
""")
def shown_stages(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("stage"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"))
    return progress.stage_states(o, "k", "stage", "state").drop("state")


@query("sql_table_uses", """
WITH o AS (SELECT o_orderkey AS id, o_custkey % 30 AS a, o_custkey % 7 AS b FROM orders)
SELECT DISTINCT id, unnest([{'t': 't' || a, 'x': 'reads', 'l': 1}, {'t': 'u' || b, 'x': 'reads', 'l': 2}, {'t': 't' || a, 'x': 'writes', 'l': 4}], recursive := true) FROM o
""".replace("SELECT DISTINCT id, unnest([", "SELECT id, x.t AS table_name, x.x AS access, x.l AS line FROM (SELECT id, unnest([").replace(", recursive := true) FROM o", ") AS x FROM o)"))
def sql_table_uses(t: Tables) -> DataFrame:
    """Orders as SQL files that read two tables and write one of them."""
    text = F.concat(F.lit("SELECT * FROM T"), (F.col("o_custkey") % 30).cast("string"), F.lit(" x\n  JOIN \"u"), (F.col("o_custkey") % 7).cast("string"), F.lit("\" y ON true;\n\nInsert  Into t"), (F.col("o_custkey") % 30).cast("string"), F.lit(" VALUES (1);"))
    _, uses = unresolved.sql_table_refs(t.orders.select(F.col("o_orderkey").alias("path"), text.alias("text")))
    return uses.select(F.col("path").alias("id"), F.col("table").alias("table_name"), "access", "line")


@query("changed_line_scan", """
WITH f AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 4 AS n FROM part WHERE p_partkey % 3 <> 0)
SELECT 'src/f' || id || '.py' AS path, unnest(range(s, s + n)) AS line FROM f
""")
def changed_line_scan(t: Tables) -> DataFrame:
    """Parts as a diff of one file each, with one hunk of none to three lines."""
    p = t.part.filter("p_partkey % 3 <> 0")
    path = _text(("src/f",), "p_partkey", (".py",))
    lines = F.array(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), F.concat(F.lit("@@ -1,2 +"), F.col("p_size").cast("string"), F.lit(","), (F.col("p_partkey") % 4).cast("string"), F.lit(" @@ def")), F.lit("+x"))
    rows = p.select(F.col("p_partkey").alias("diff_id"), F.posexplode(lines).alias("pos", "line"))
    return unresolved.changed_lines(rows)


@query("change_sides", """
WITH c AS (SELECT o_orderkey AS id, o_custkey % 50 AS k FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT p_partkey % 2 AS snap, p_partkey % 50 AS k, max(p_name) AS v FROM part WHERE p_partkey % 7 <> 1 GROUP BY 1, 2)
SELECT id AS change_id, b.v AS before, a.v AS after FROM c LEFT JOIN f b ON b.snap = 0 AND b.k = c.k LEFT JOIN f a ON a.snap = 1 AND a.k = c.k
""")
def change_sides(t: Tables) -> DataFrame:
    c = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("change_id"), F.lit(0).alias("source_snapshot"), F.lit(1).alias("target_snapshot"), (F.col("o_custkey") % 50).alias("stable_key"))
    f = t.part.filter("p_partkey % 7 <> 1").groupBy((F.col("p_partkey") % 2).cast("int").alias("snapshot_id"), (F.col("p_partkey") % 50).alias("stable_key")).agg(F.max("p_name").alias("values"))
    return assembly.change_sides(c, f).select("change_id", "before", "after")


@query("node_labels", """
WITH r AS (SELECT l_suppkey AS a, l_partkey % 120 AS b, l_returnflag || l_linestatus AS l FROM lineitem WHERE l_quantity > 49), e AS (SELECT a AS n, l FROM r UNION SELECT b, l FROM r)
SELECT s_suppkey AS node, coalesce(string_agg(l, ',' ORDER BY l), '') AS labels FROM supplier LEFT JOIN e ON n = s_suppkey GROUP BY 1
""")
def node_labels(t: Tables) -> DataFrame:
    r = t.lineitem.filter("l_quantity > 49").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 120).alias("b"), F.concat("l_returnflag", "l_linestatus").alias("l"))
    out = assembly.labelled(t.supplier.select(F.col("s_suppkey").alias("node")), r, "node", "a", "b", "l")
    return out.withColumn("labels", F.array_join("labels", ","))


@query("json_members", """
SELECT DISTINCT o_orderkey AS id, unnest(['c' || o_custkey % 9, 'p' || substring(o_orderpriority, 1, 1), 'c' || o_orderkey % 9]) AS member FROM orders WHERE o_orderstatus <> 'P'
""")
def json_members(t: Tables) -> DataFrame:
    """Orders as documents with a nested array; those in progress have none."""
    refs = F.array(F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)), F.concat(F.lit("c"), (F.col("o_orderkey") % 9).cast("string")), F.lit(None).cast("string"))
    document = F.when(F.col("o_orderstatus") == "P", '{"a": {"refs": "none"}}').otherwise(F.to_json(F.struct(F.struct(refs.alias("refs")).alias("a"))))
    return assembly.members_of_json(t.orders.select(F.col("o_orderkey").alias("id"), document.alias("d")), "id", "d", "$.a.refs")


@query("node_facts", """
WITH n AS (SELECT o_orderkey AS id, o_custkey % 40 AS doc, unnest(['k' || o_orderkey % 12, 'k' || o_custkey % 12]) AS k FROM orders), f AS (SELECT p_partkey AS ref, p_partkey % 40 AS doc, 'k' || p_size % 12 AS k FROM part WHERE p_partkey % 3 = 0)
SELECT DISTINCT id AS node_id, ref AS fact_ref FROM n JOIN f USING (doc, k) WHERE doc % 5 <> 0
""")
def node_facts(t: Tables) -> DataFrame:
    key = lambda c: F.concat(F.lit("k"), (F.col(c) % 12).cast("string"))
    n = t.orders.select(F.col("o_orderkey").alias("node_id"), F.lit("s").alias("snapshot_id"), (F.col("o_custkey") % 40).alias("document_id"), F.array(key("o_orderkey"), key("o_custkey")).alias("business_keys"))
    m = t.spark.range(40).filter("id % 5 <> 0").select(F.lit("s").alias("snapshot_id"), F.col("id").alias("document_id"), (F.col("id") + 100).alias("version_id"))
    f = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("fact_ref"), (F.col("p_partkey") % 40 + 100).alias("version_id"), key("p_size").alias("stable_key"))
    return assembly.facts_by_business_key(n, f, m)


@query("data_traces", """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus <> 'F' AS ok FROM orders WHERE o_orderkey % 4 <> 0),
s AS (SELECT l_suppkey AS d, bool_or(NOT ok) AS failed, bool_or(l_discount = 0 OR ok IS NULL) AS open FROM lineitem LEFT JOIN r ON k = l_orderkey WHERE l_quantity > 45 AND l_suppkey % 3 <> 0 AND l_orderkey % 5 = 0 GROUP BY 1)
SELECT s_suppkey AS data_id, CASE WHEN d IS NULL THEN 'unmapped' WHEN failed THEN 'failed' WHEN open THEN 'unproven' ELSE 'proven' END AS status FROM supplier LEFT JOIN s ON d = s_suppkey
""")
def data_traces(t: Tables) -> DataFrame:
    steps = t.lineitem.filter("l_quantity > 45 AND l_suppkey % 3 <> 0 AND l_orderkey % 5 = 0").select(F.col("l_linenumber").cast("string").alias("flow_id"), F.col("l_orderkey").alias("step_id"), F.col("l_suppkey").alias("data_id"), F.when(F.col("l_discount") == 0, 0).otherwise(1).alias("assertions"))
    results = t.orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("step_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed").alias("status"), F.col("o_orderpriority").alias("evidence_ref"))
    return assembly.data_traces(t.supplier.select(F.col("s_suppkey").alias("data_id")), steps, results).select("data_id", "status")


@query("flow_violations", """
WITH p AS (SELECT l_orderkey AS flow, count(*) AS n, count(DISTINCT l_partkey) AS ids, min(l_linenumber) AS low, max(l_linenumber) AS high, count(DISTINCT l_linenumber) AS places FROM lineitem GROUP BY 1)
SELECT flow, 'step_id_repeated' AS rule FROM p WHERE ids < n UNION ALL SELECT flow, 'sequence_gap' FROM p WHERE low <> 1 OR high <> places UNION ALL SELECT flow, 'sequence_repeated' FROM p WHERE places < n
""")
def flow_violations(t: Tables) -> DataFrame:
    return assembly.flow_violations(t.lineitem.withColumnRenamed("l_orderkey", "flow"), "flow", "l_partkey", "l_linenumber")


@query("next_stages", """
SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 <> 0 THEN 'documents' WHEN o_orderkey % 3 <> 0 THEN 'code_scope' WHEN o_orderstatus <> 'F' THEN 'tests' END AS next_stage,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'wait_for_review' WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'close' ELSE 'run' END AS action FROM orders
""")
def next_stages(t: Tables) -> DataFrame:
    stages = [("documents", F.col("o_custkey") % 2 == 0), ("code_scope", F.col("o_orderkey") % 3 == 0), ("tests", F.col("o_orderstatus") == "F")]
    return assembly.next_stage(t.orders, "o_orderkey", stages, F.col("o_orderpriority") == "1-URGENT").withColumnRenamed("o_orderkey", "id")


@query("recovery_order", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'stale' WHEN o_orderpriority = '1-URGENT' THEN 'retry' ELSE 'new' END AS recovery_class FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT'
ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 100
""")
def recovery_order(t: Tables) -> DataFrame:
    classes = [("stale", F.col("o_orderstatus") == "P"), ("retry", F.col("o_orderpriority") == "1-URGENT"), ("new", F.col("o_orderstatus") == "O")]
    return assembly.recovery_order(t.orders, "o_orderkey", classes, "o_orderdate", 100).select(F.col("o_orderkey").alias("id"), "recovery_class")


@query("embedding_inputs", """
SELECT p_partkey AS node_id, sha256('v1' || chr(0) || '{"business_keys":["' || least(p_brand, p_type) || '","' || greatest(p_brand, p_type) || '"],"content":"' || p_name || '","summary":"' || p_type || '"}') AS input_digest, p_type || chr(10) || p_name || chr(10) || least(p_brand, p_type) || chr(10) || greatest(p_brand, p_type) AS keywords FROM part
""")
def embedding_inputs(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_partkey").alias("node_id"), F.array("p_brand", "p_type").alias("business_keys"), F.col("p_name").alias("content"), F.col("p_type").alias("summary"))
    return assembly.embedding_inputs(n, "v1").select("node_id", "input_digest", "keywords")
