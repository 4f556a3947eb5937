"""Diffs, resolutions, monitoring, coverage, graphs and queue views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conditions
from ..functions import text as fn
from ..operators import aggregates, cycles, graph, progress, ranking, reduction, resolve
from ..streaming import state
from .registry import Tables, query




@query("snapshot_diff", """
WITH a AS (SELECT p_partkey AS k, p_name AS n, p_retailprice AS p FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT p_partkey AS k, CASE WHEN p_size > 45 THEN p_name || '!' ELSE p_name END AS n,
             CASE WHEN p_size > 40 THEN p_retailprice + 1 ELSE p_retailprice END AS p FROM part WHERE p_partkey % 5 <> 0),
x AS (SELECT coalesce(a.k, b.k) AS part_key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.n <> b.n OR a.p <> b.p THEN 'modified' END AS change_type,
             concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'name' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'price' END) AS changed_fields
      FROM a FULL JOIN b ON a.k = b.k)
SELECT * FROM x WHERE change_type IS NOT NULL
""")
def snapshot_diff(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), "p_size")
    later = p.withColumns({"name": F.when(F.col("p_size") > 45, F.concat("name", F.lit("!"))).otherwise(F.col("name")), "price": F.when(F.col("p_size") > 40, F.col("price") + 1).otherwise(F.col("price"))})
    diff = resolve.snapshot_diff(p.filter("part_key % 7 <> 0"), later.filter("part_key % 5 <> 0"), "part_key", ["name", "price"])
    return diff.withColumn("changed_fields", F.array_join("changed_fields", ","))


_RESOLVE_SQL = """
WITH s AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS nation, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'NONE' END AS segment FROM supplier),
c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(DISTINCT c_custkey) AS n, min(c_custkey) AS m FROM customer WHERE c_acctbal > 9000 GROUP BY 1, 2),
j AS (SELECT source_id, s.nation, coalesce(n, 0) AS candidate_count, m,
      CASE WHEN s.nation IS NULL THEN 'missing_source_value' WHEN n IS NULL THEN 'no_target' WHEN n > 1 THEN 'ambiguous_target' WHEN m = source_id THEN 'self_target' ELSE 'resolved' END AS reason
      FROM s LEFT JOIN c ON s.nation = c.nation AND s.segment = c.segment)
"""


def _relations(t: Tables) -> DataFrame:
    segment = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "MACHINERY").otherwise("NONE")
    s = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("nation"), segment.alias("segment"))
    c = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_custkey")
    return resolve.resolve_unique(s, c, ["nation", "segment"], "source_id", "c_custkey")


@query("tuple_relation_resolve", _RESOLVE_SQL + "SELECT source_id, m AS target FROM j WHERE reason = 'resolved'")
def tuple_relation_resolve(t: Tables) -> DataFrame:
    return _relations(t).filter("reason = 'resolved'").select("source_id", "target")


@query("tuple_relation_unresolved", _RESOLVE_SQL + "SELECT source_id, reason, candidate_count FROM j WHERE reason <> 'resolved'")
def tuple_relation_unresolved(t: Tables) -> DataFrame:
    return _relations(t).filter("reason <> 'resolved'").select("source_id", "reason", "candidate_count")


@query("first_kind_lookup", """
WITH k AS (SELECT c_nationkey AS nation, 0 AS kind, c_custkey AS id FROM customer WHERE c_acctbal > 9900
           UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier),
b AS (SELECT nation, min(kind) AS kind FROM k GROUP BY nation),
c AS (SELECT nation, count(DISTINCT id) AS n, min(id) AS m FROM k JOIN b USING (nation, kind) GROUP BY nation)
SELECT n_nationkey AS nation, CASE WHEN n = 1 THEN m END AS target, coalesce(n, 0) AS candidate_count,
       CASE WHEN n IS NULL THEN 'no_target' WHEN n > 1 THEN 'ambiguous_target' WHEN m = n_nationkey THEN 'self_target' ELSE 'resolved' END AS reason
FROM nation LEFT JOIN c ON nation = n_nationkey
""")
def first_kind_lookup(t: Tables) -> DataFrame:
    kinds = [t.customer.filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")), t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))]
    left = t.nation.select(F.col("n_nationkey").alias("nation"))
    out = resolve.first_kind_wins(left, kinds, ["nation"], "nation", "id")
    return out.select("nation", F.when(F.col("candidate_count") == 1, F.col("target")).alias("target"), "candidate_count", "reason")


@query("sibling_band_expand", """
SELECT DISTINCT a.conv_id, a.turn AS seed_turn, b.turn FROM conversations a JOIN conversations b
ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 2 AND a.turn <> b.turn WHERE a.role = 'assistant'
""")
def sibling_band_expand(t: Tables) -> DataFrame:
    c = t.conversations
    return resolve.sibling_band(c, c.filter("role = 'assistant'"), "conv_id", "turn", 2).select("conv_id", F.col("seed_ordinal").alias("seed_turn"), "turn")


@query("endpoint_or_expand", """
WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), n AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 8000)
SELECT node, CASE WHEN e.a = node THEN e.b ELSE e.a END AS other FROM n JOIN e ON e.a = node OR e.b = node WHERE NOT (e.a = node AND e.b = node)
UNION SELECT node, e.a FROM n JOIN e ON e.a = node AND e.b = node
""")
def endpoint_or_expand(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return resolve.other_endpoints(e, t.supplier.filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("node")), "a", "b", "node")


@query("latest_event", """
SELECT user_id, event_type AS status, event_id, n_events FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) WHERE rn = 1
""")
def latest_event(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return state.latest_state(e, "user_id", ["ts", "event_id"], ["status", "event_id"])


@query("latest_per_kind", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_kind(t: Tables) -> DataFrame:
    return resolve.latest_by(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("no_newer_row", """
SELECT e.user_id, e.event_id FROM events e WHERE e.event_type = 'purchase'
AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_type = 'purchase' AND n.user_id = e.user_id AND (n.ts, n.event_id) > (e.ts, e.event_id))
""")
def no_newer_row(t: Tables) -> DataFrame:
    return resolve.latest_by(t.events.filter("event_type = 'purchase'"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("ready_tasks", """
SELECT o_orderkey, o_orderpriority FROM orders o WHERE o_orderstatus = 'O'
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F')
AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 10)
""")
def ready_tasks(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority")
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", "l_quantity")  # noqa: E741
    return o.join(l.filter("l_linestatus = 'F'"), "o_orderkey", "left_anti").join(l.filter("l_quantity > 10"), "o_orderkey", "left_semi")


@query("total_before_limit", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def total_before_limit(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.crossJoin(o.agg(F.count("*").alias("total")))  # one row


@query("monitoring_stats", """
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_slow, round(avg(value), 4) AS avg_wait, round(quantile_cont(value, 0.95), 4) AS p95_wait,
       round(count(*) FILTER (value > 50) / count(*), 4) AS slow_rate, max(ts) AS last_seen
FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 240 HOUR AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type
""")
def monitoring_stats(t: Tables) -> DataFrame:
    end = F.lit("2024-01-15").cast("timestamp")
    e = t.events.filter((F.col("ts") >= end - F.expr("INTERVAL 240 HOURS")) & (F.col("ts") < end))
    slow = F.count_if(F.col("value") > 50)
    counts = e.groupBy("event_type").agg(
        F.count("*").alias("n"), slow.alias("n_slow"), F.round(F.avg("value"), 4).alias("avg_wait"),
        aggregates.rate(slow, F.count("*")).alias("slow_rate"), F.max("ts").alias("last_seen"),
    )
    waits = aggregates.exact_quantile(e, "event_type", "value", 0.95, "p95_wait")
    return counts.join(waits, "event_type", "left").withColumn("p95_wait", F.round("p95_wait", 4))


@query("monitoring_alerts", """
WITH s AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type)
SELECT event_type, 'backlog' AS alert FROM s WHERE n > 2000 UNION ALL SELECT event_type, 'p95_wait' FROM s WHERE p95 > 50
""")
def monitoring_alerts(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type").agg(F.count("*").alias("n")).join(aggregates.exact_quantile(t.events, "event_type", "value", 0.95, "p95"), "event_type", "left")
    rules = F.array(F.when(F.col("n") > 2000, F.lit("backlog")), F.when(F.col("p95") > 50, F.lit("p95_wait")))
    return s.select("event_type", F.explode(F.filter(rules, lambda a: a.isNotNull())).alias("alert"))


@query("top_blockers", """
SELECT coalesce(nullif(event_type, 'signup'), 'none') AS reason, user_id % 7 AS run, count(*) AS n, max(ts) AS last_seen
FROM events GROUP BY 1, 2 ORDER BY n DESC, last_seen DESC, reason, run LIMIT 10
""")
def top_blockers(t: Tables) -> DataFrame:
    e = t.events.groupBy(F.coalesce(F.nullif("event_type", F.lit("signup")), F.lit("none")).alias("reason"), (F.col("user_id") % 7).alias("run"))
    return e.agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).orderBy(F.desc("n"), F.desc("last_seen"), "reason", "run").limit(10)


@query("dependency_arrays", """
SELECT o_orderkey, count(l_partkey) AS n, array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL)), ',') AS parts
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW' GROUP BY o_orderkey
""")
def dependency_arrays(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_partkey").alias("n"), F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    out = t.orders.filter("o_orderpriority = '5-LOW'").select("o_orderkey").join(lines, "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.size("parts") > 0, F.array_join(F.col("parts").cast("array<string>"), ",")).alias("parts"))


@query("project_rollup", """
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name
""")
def project_rollup(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    out = t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return out.select("n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "suppliers")])


@query("coverage_division", """
SELECT l_suppkey FROM lineitem WHERE l_returnflag || l_linestatus IN (SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem)
AND l_quantity > 40 GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)
""")
def coverage_division(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("kind"), "l_quantity")
    return aggregates.relational_division(rows.filter("l_quantity > 40"), "l_suppkey", "kind", rows)


@query("conflict_detection", """
WITH f AS (SELECT o_custkey AS c, 'status' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_custkey, 'priority', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END FROM orders),
g AS (SELECT c, field, count(DISTINCT lower(trim(v))) AS n FROM f WHERE v IS NOT NULL GROUP BY 1, 2),
p AS (SELECT c, list_sort(list(field) FILTER (n > 1)) AS conflicts, list(field) AS present FROM g GROUP BY c)
SELECT c AS custkey, CASE WHEN len(conflicts) > 0 THEN 'conflicting' WHEN len(present) < 2 THEN 'missing' ELSE 'accepted' END AS status,
       coalesce(array_to_string(conflicts, ','), '') AS conflicts
FROM (SELECT DISTINCT c FROM f) LEFT JOIN p USING (c)
""")
def conflict_detection(t: Tables) -> DataFrame:
    o = t.orders
    rows = o.select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.lit("status").alias("field"), F.col("o_orderstatus").alias("v")).unionByName(
        o.select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.lit("priority").alias("field"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("v"))
    )
    out = aggregates.conflicting_fields(rows, "custkey", "field", "v", "o_orderkey", ["priority", "status"])
    return out.select("custkey", "status", F.array_join("conflicts", ",").alias("conflicts"))


@query("variant_scoring", """
WITH s AS (SELECT doc_id, v, (CASE WHEN contains(lower(text), w1) THEN 0.6 ELSE 0 END + CASE WHEN contains(lower(text), w2) THEN 0.4 ELSE 0 END)::DOUBLE AS score
  FROM documents, (VALUES ('en', 'the ', 'tion'), ('fr', ' le ', ' de '), ('de', ' der ', ' die ')) x(v, w1, w2)),
b AS (SELECT doc_id, max(score) AS best FROM s GROUP BY doc_id),
n AS (SELECT doc_id, best, count(*) AS n, min(v) AS v FROM s JOIN b USING (doc_id) WHERE best - score <= 1e-9 GROUP BY 1, 2)
SELECT doc_id, CASE WHEN best >= 0.6 AND n = 1 THEN v END AS variant, best AS score,
       CASE WHEN best < 0.6 THEN 'below_threshold' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS reason FROM n
""")
def variant_scoring(t: Tables) -> DataFrame:
    rules = [("en", "the ", "tion"), ("fr", " le ", " de "), ("de", " der ", " die ")]
    low = t.documents.select("doc_id", F.lower("text").alias("x"))
    has = lambda w, p: F.when(F.contains("x", F.lit(w)), p).otherwise(0.0)
    scores = low.select("doc_id", F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), (has(a, 0.6) + has(b, 0.4)).alias("score")) for v, a, b in rules])))
    return aggregates.best_variant(scores, "doc_id", "variant", "score", 0.6)


@query("changed_line_coverage", """
WITH c AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem WHERE l_quantity > 20),
x AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem WHERE l_tax > 0.01),
h AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem WHERE l_discount < 0.08),
k AS (SELECT DISTINCT l_orderkey AS path FROM lineitem WHERE l_orderkey % 9 <> 0),
j AS (SELECT c.path, count(*) FILTER (k.path IS NULL OR x.path IS NOT NULL) AS changed_lines, count(*) FILTER (k.path IS NOT NULL AND x.path IS NOT NULL AND h.path IS NOT NULL) AS covered_lines
      FROM c LEFT JOIN x ON x.path = c.path AND x.line = c.line LEFT JOIN h ON h.path = c.path AND h.line = c.line LEFT JOIN k ON k.path = c.path GROUP BY c.path)
SELECT path, changed_lines, covered_lines, CASE WHEN changed_lines = 0 THEN 100.0::DOUBLE ELSE round(covered_lines * 100.0::DOUBLE / changed_lines, 2) END AS percent,
       CASE WHEN changed_lines = 0 OR round(covered_lines * 100.0::DOUBLE / changed_lines, 2) >= 80 THEN 'passed' ELSE 'failed' END AS status FROM j
""")
def changed_line_coverage(t: Tables) -> DataFrame:
    l = t.lineitem.withColumnsRenamed({"l_orderkey": "path", "l_linenumber": "line"})  # noqa: E741
    return aggregates.changed_line_coverage(l.filter("l_quantity > 20"), l.filter("l_tax > 0.01"), l.filter("l_discount < 0.08"), l.filter("path % 9 <> 0"))


@query("criterion_coverage", """
SELECT user_id, count(*) AS n_conditions, bool_and(value <= 60) AS covered, count(*) FILTER (value > 60) AS n_failed FROM events WHERE event_type = 'click' GROUP BY user_id
""")
def criterion_coverage(t: Tables) -> DataFrame:
    return progress.criterion_coverage(t.events.filter("event_type = 'click'"), "user_id", F.col("value") <= 60)


@query("closure_status", """
WITH v AS (SELECT l_orderkey AS k, 'blocked' AS kind, 'returned' AS reason FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45
  UNION SELECT l_orderkey, 'failed', 'discounted' FROM lineitem WHERE l_discount > 0.09
  UNION SELECT l_orderkey, 'reanalysis_required', 'large' FROM lineitem WHERE l_extendedprice > 95000)
SELECT o_orderkey, CASE WHEN bool_or(kind = 'reanalysis_required') THEN 'reanalysis_required' WHEN bool_or(kind = 'blocked') THEN 'blocked' WHEN bool_or(kind = 'failed') THEN 'failed' ELSE 'passed' END AS status,
       coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ','), '') AS reasons
FROM orders LEFT JOIN v ON k = o_orderkey GROUP BY o_orderkey
""")
def closure_status(t: Tables) -> DataFrame:
    l = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")  # noqa: E741
    tell = lambda cond, kind, reason: l.filter(cond).select("o_orderkey", F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    found = tell("l_returnflag = 'R' and l_quantity > 45", "blocked", "returned").unionByName(tell("l_discount > 0.09", "failed", "discounted")).unionByName(tell("l_extendedprice > 95000", "reanalysis_required", "large"))
    out = aggregates.verdict(found, t.orders, "o_orderkey", ["reanalysis_required", "blocked", "failed"])
    return out.select("o_orderkey", "status", F.array_join("reasons", ",").alias("reasons"))


@query("unresolved_closure", """
WITH f AS (SELECT event_id AS finding, user_id, value FROM events WHERE event_type = 'error'),
e AS (SELECT event_id AS edge, user_id, value FROM events WHERE event_type = 'purchase'),
m AS (SELECT finding, edge FROM f JOIN e ON f.value = e.value UNION SELECT finding, edge FROM f JOIN e ON f.user_id = e.user_id AND f.value = e.value),
c AS (SELECT finding, count(DISTINCT edge) AS n, min(edge) AS edge FROM m GROUP BY finding)
SELECT f.finding, CASE WHEN n = 1 THEN edge END AS closed_by, coalesce(n, 0) AS edge_count FROM f LEFT JOIN c USING (finding)
""")
def unresolved_closure(t: Tables) -> DataFrame:
    cols = ["user_id", "value"]
    f = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("finding"), *cols, F.struct(*cols).alias("place"))
    e = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("edge"), *cols, F.struct(*cols).alias("place"))
    return resolve.close_findings(f, e, "finding", "edge", ["value", "place"])


@query("two_hop_closure", """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1000000 AS d FROM lineitem WHERE l_quantity > 48),
b AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
h0 AS (SELECT 1::BIGINT AS node), h1 AS (SELECT DISTINCT d AS node FROM b JOIN h0 ON s = node WHERE d NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT d AS node FROM b JOIN h1 ON s = node WHERE d NOT IN (SELECT node FROM h0) AND d NOT IN (SELECT node FROM h1))
SELECT node, 0 AS distance FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2
""")
def two_hop_closure(t: Tables) -> DataFrame:
    e = t.lineitem.filter("l_quantity > 48").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    return graph.within_hops(e, t.spark.range(1, 2).toDF("node"))


@query("transitive_closure", """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0),
p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)
SELECT src, dst FROM p
""")
def transitive_closure(t: Tables) -> DataFrame:
    return graph.transitive_closure(t.part.filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst")))


@query("topological_levels", """
WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 4 AS needs FROM part WHERE p_partkey > 0),
l AS (SELECT 0::BIGINT AS node, 0 AS level UNION ALL SELECT e.node, l.level + 1 FROM e JOIN l ON e.needs = l.node)
SELECT node, level FROM l
""")
def topological_levels(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("node"))
    return graph.topological_levels(p, p.filter("node > 0").withColumn("needs", F.expr("node div 4")))


@query("topological_order", """
WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 4 AS needs FROM part WHERE p_partkey > 0),
l AS (SELECT 0::BIGINT AS node, 0 AS level UNION ALL SELECT e.node, l.level + 1 FROM e JOIN l ON e.needs = l.node)
SELECT node, level, row_number() OVER (ORDER BY level, node) AS place FROM l
""")
def topological_order(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("node"))
    return cycles.topological_order(p, p.filter("node > 0").withColumn("needs", F.expr("node div 4")))


@query("cycle_members", """
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey // 12 AS b, c_custkey % 12 AS i, max(c_custkey) OVER () AS top FROM customer),
e AS (SELECT DISTINCT src, dst FROM (
        SELECT k AS src, 12 * b + (5 * i + b) % 12 AS dst, top FROM c WHERE (k + b) % 5 <> 0
        UNION ALL SELECT k, 12 * b + (i * i + 1) % 12, top FROM c WHERE k % 3 = 0
        UNION ALL SELECT k, k + 12, top FROM c WHERE i = 0 AND b % 4 <> 3) WHERE dst <= top),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
m AS (SELECT a.src AS node, min(b.src) AS component FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src GROUP BY a.src)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m
""")
def cycle_members(t: Tables) -> DataFrame:
    """Customers in groups of twelve, with one or two edges each inside the group and some to the next."""
    c = t.customer.select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 12").alias("b"), (F.col("c_custkey") % 12).alias("i"))
    last = t.customer.agg(F.max("c_custkey")).first()[0]
    edge = lambda rule, dst: c.filter(rule).select(F.col("k").alias("src"), F.expr(dst).alias("dst"))
    edges = edge("(k + b) % 5 <> 0", "12 * b + (5 * i + b) % 12").unionByName(edge("k % 3 = 0", "12 * b + (i * i + 1) % 12")).unionByName(edge("i = 0 AND b % 4 <> 3", "k + 12"))
    return cycles.cycle_members(edges.filter(F.col("dst") <= (last or 0)))


@query("deep_evidence", """
SELECT r_name AS region, c_custkey AS customer, o_orderkey AS orderkey, l_linenumber AS line, p_brand AS brand, s_suppkey AS supplier, event_id AS event
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN events ON user_id = c_custkey
WHERE r_regionkey < 2 AND p_size <= 10 AND s_acctbal > 0 AND value > 20
""")
def deep_evidence(t: Tables) -> DataFrame:
    """Eight tables, reduced to what takes part before they are joined."""
    tables = {
        "orders": t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("customer")),
        "customer": t.customer.select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation")),
        "nation": t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region_key")),
        "region": t.region.filter("r_regionkey < 2").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region")),
        "events": t.events.filter("value > 20").select(F.col("user_id").alias("customer"), F.col("event_id").alias("event")),
        "lineitem": t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")),
        "part": t.part.filter("p_size <= 10").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")),
        "supplier": t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier")),
    }
    tree = [
        ("customer", "orders", ["customer"]), ("nation", "customer", ["nation"]), ("region", "nation", ["region_key"]), ("lineitem", "orders", ["orderkey"]),
        ("part", "lineitem", ["part"]), ("supplier", "lineitem", ["supplier"]), ("events", "customer", ["customer"]),
    ]
    return reduction.joined(tables, tree).select("region", "customer", "orderkey", "line", "brand", "supplier", "event")


@query("incremental_rescan", """
WITH RECURSIVE a AS (SELECT p_partkey AS k, p_size AS d FROM part WHERE p_partkey % 97 <> 5),
b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 101 = 7 THEN p_size + 1 ELSE p_size END AS d FROM part WHERE p_partkey % 89 <> 3),
own AS (SELECT coalesce(a.k, b.k) AS k FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.d <> b.d),
l AS (SELECT p_partkey AS k, p_partkey // 3 AS uses FROM part WHERE p_partkey > 2),
h AS (SELECT k FROM own UNION SELECT l.k FROM l JOIN h ON l.uses = h.k)
SELECT b.k AS part, b.d AS size, b.k IN (SELECT k FROM h) AS rescanned, coalesce(u.d, -1) AS used_size
FROM b LEFT JOIN l ON l.k = b.k LEFT JOIN b AS u ON u.k = l.uses
""")
def incremental_rescan(t: Tables) -> DataFrame:
    """Parts as files that use another one: what changed, and all that uses it over any number of links, is scanned again."""
    p = t.part.select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    old, new = p.filter("part % 97 <> 5"), p.withColumn("size", F.when(F.col("part") % 101 == 7, F.col("size") + 1).otherwise(F.col("size"))).filter("part % 89 <> 3")
    links = p.filter("part > 2").select("part", F.expr("part div 3").alias("uses"))

    def scan(files: DataFrame, rows: DataFrame) -> DataFrame:
        """Each of ``rows`` with the size of what it uses among ``files``."""
        used = files.select(F.col("part").alias("uses"), F.col("size").alias("used_size"))
        return rows.join(links, "part", "left").join(used, "uses", "left").select("part", "size", F.coalesce("used_size", F.lit(-1)).alias("used_size"))

    out = graph.incremental_rescan(scan(old, old), old, new, links, "part", "size", lambda rows: scan(new, rows))
    return out.select("part", "size", "rescanned", "used_size")


@query("incremental_affected", """
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS d FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS d FROM orders WHERE o_orderkey % 17 <> 0),
x AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'changed' END AS own FROM a FULL JOIN b ON a.k = b.k),
h AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN x ON x.k = l_partkey WHERE own IS NOT NULL)
SELECT x.k AS orderkey, coalesce(own, CASE WHEN h.k IS NOT NULL THEN 'affected' END, 'reused') AS action FROM x LEFT JOIN h ON h.k = x.k
""")
def incremental_affected(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("digest"))
    new = o.withColumn("digest", F.when(F.col("orderkey") % 13 == 0, F.col("digest") + 1).otherwise(F.col("digest")))
    links = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("uses"))
    return graph.incremental_plan(o.filter("orderkey % 11 <> 0"), new.filter("orderkey % 17 <> 0"), links, "orderkey", "digest")


@query("route_template_match", r"""
WITH r AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*$', ''), '/$', '') AS route FROM pages),
t AS (SELECT * FROM (VALUES (1, '^/en/[^/]+$'), (2, '^/[^/]+/[0-9]*5$')) x(template_id, p)),
m AS (SELECT route, count(*) AS n, min(CASE WHEN template_id = 1 THEN 1 ELSE 2 END) AS m FROM r JOIN (VALUES (1, '^/en/[^/]+$'), (2, '^/[^/]+/25$'), (3, '^/fr/[^/]+$')) x(template_id, p) ON regexp_matches(route, p) GROUP BY route)
SELECT r.route, CASE WHEN n IS NULL THEN 'endpoint_not_found' WHEN n > 1 THEN 'endpoint_ambiguous' ELSE 'resolved_unique' END AS reason,
       coalesce(n, 0) AS candidate_count FROM r LEFT JOIN m ON m.route = r.route WHERE r.route <> ''
""")
def route_template_match(t: Tables) -> DataFrame:
    templates = t.spark.createDataFrame([(1, "/en/{id}"), (2, "/{lang}/25"), (3, "/fr/:id")], "template_id int, template string")
    templates = templates.withColumn("template", fn.route_template(F.col("template")))
    routes = t.pages.select(fn.url_path(F.col("url")).alias("route")).filter("route <> '/'")
    return resolve.match_routes(routes, templates, "route", "template", "template_id").select("route", "reason", "candidate_count")


@query("interval_enclosing", """
WITH i AS (SELECT l_orderkey AS k, l_linenumber AS id, l_linenumber * 3 AS s, l_linenumber * 3 + l_quantity::INT AS e FROM lineitem),
p AS (SELECT o_orderkey AS k, (o_orderkey % 60)::INT AS line FROM orders),
j AS (SELECT p.k, p.line, i.id FROM p JOIN i ON i.k = p.k AND p.line BETWEEN s AND e QUALIFY row_number() OVER (PARTITION BY p.k, p.line ORDER BY e - s, id) = 1)
SELECT p.k AS orderkey, p.line, j.id AS callable FROM p LEFT JOIN j ON j.k = p.k AND j.line = p.line
""")
def interval_enclosing(t: Tables) -> DataFrame:
    start = F.col("l_linenumber") * 3
    i = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("callable"), start.alias("s"), (start + F.col("l_quantity").cast("int")).alias("e"))
    p = t.orders.select(F.col("o_orderkey").alias("orderkey"), (F.col("o_orderkey") % 60).cast("int").alias("line"))
    return resolve.innermost_interval(p, i, "orderkey", "line", "s", "e", "callable")


@query("fairness_schedule", """
WITH c AS (SELECT user_id, count(*) AS recent_claims FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-29' GROUP BY user_id)
SELECT event_id, coalesce(recent_claims, 0) AS recent_claims,
       row_number() OVER (ORDER BY (value > 50) DESC, coalesce(recent_claims, 0), ts, event_id) AS place
FROM events e LEFT JOIN c USING (user_id) WHERE event_type = 'signup'
""")
def fairness_schedule(t: Tables) -> DataFrame:
    e = t.events
    order = [F.desc(F.col("value") > 50), F.col("recent_claims"), F.col("ts"), F.col("event_id")]
    claims = e.filter((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp")))
    return ranking.fair_schedule(e.filter("event_type = 'signup'"), claims, "user_id", order).select("event_id", "recent_claims", "place")


@query("json_condition_eval", """
SELECT event_id, (json_extract(props, '$.k')::INT) > 50 AS passed,
       CASE WHEN (json_extract(props, '$.k')::INT) > 50 THEN 'satisfied' ELSE 'not_satisfied' END AS reason, 'missing_path' AS absent FROM events
""")
def json_condition_eval(t: Tables) -> DataFrame:
    c = conditions.condition(F.col("props"), "$.k", "gt", 50)
    return t.events.select("event_id", c["passed"].alias("passed"), c["reason"].alias("reason"), conditions.condition(F.col("props"), "$.none.x", "exists")["reason"].alias("absent"))


@query("effective_queue_state", """
WITH q AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'claimed' WHEN 'F' THEN 'done' ELSE 'ready' END AS state, o_orderkey % 3 AS attempts FROM orders),
c AS (SELECT l_orderkey AS task_id, max(l_shipdate) AS until FROM lineitem GROUP BY 1)
SELECT q.task_id, state, CASE WHEN state = 'claimed' AND until <= TIMESTAMP '1998-06-01' AND attempts >= 2 THEN 'failed' WHEN state = 'claimed' AND until <= TIMESTAMP '1998-06-01' THEN 'ready' ELSE state END AS effective_state
FROM q LEFT JOIN c USING (task_id)
""")
def effective_queue_state(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "O", "claimed").when(F.col("o_orderstatus") == "F", "done").otherwise("ready")
    q = t.orders.select(F.col("o_orderkey").alias("task_id"), name.alias("state"), (F.col("o_orderkey") % 3).alias("attempt_count"), F.lit(2).alias("max_attempts"))
    c = t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("lease_expires_at"))
    return state.effective_tasks(q, c, "1998-06-01").select("task_id", "state", "effective_state")


@query("windowed_event_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(t: Tables) -> DataFrame:
    return state.windowed_counts(t.events, "ts", "event_type")


@query("header_carry_forward", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS question_turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
""")
def header_carry_forward(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.conversations.select("conv_id", "turn", asked.alias("question_turn"), F.lead("turn").over(w).alias("next_turn"))


@query("stage_progress", """
SELECT o_custkey AS custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS stages,
       min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS current_stage, round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*)) AS percent
FROM orders GROUP BY o_custkey
""")
def stage_progress(t: Tables) -> DataFrame:
    return progress.stage_progress(t.orders.withColumnRenamed("o_custkey", "custkey"), "custkey", "o_orderkey", F.col("o_orderstatus") == "F")


@query("capability_match", """
SELECT p_partkey, p_size FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND (p_name LIKE '%ring%' OR p_name LIKE '%widget%')
""")
def capability_match(t: Tables) -> DataFrame:
    """Rows whose needed capabilities are a subset of those on offer."""
    needs = F.array("p_type", F.element_at(F.split("p_name", " "), -1))
    return progress.capable(t.part, needs, ("ECONOMY", "STANDARD", "ring", "widget")).select("p_partkey", "p_size")


@query("html_route_scan", r"""
SELECT page_id, len(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS n_links, array_to_string(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), ' ') AS links FROM pages
""")
def html_route_scan(t: Tables) -> DataFrame:
    return progress.matched_parts(t.pages, "page_id", "html", r'<a href="(/[^"]*)"', "links").withColumn("links", F.array_join("links", " "))
