"""Publishing, validation, readiness, propagation and context queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import ledger, progress, publishing
from .registry import Tables, query


@query("section_slices", """
SELECT p_type AS section, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS ordinal,
       dense_rank() OVER (ORDER BY p_type) - 1 AS section_ordinal, count(*) OVER (PARTITION BY p_type) AS fact_count FROM part
""")
def section_slices(t: Tables) -> DataFrame:
    """Sections are counted and ranked on their own, few rows, and joined back; slices are numbered inside them."""
    sections = t.part.groupBy(F.col("p_type").alias("section")).agg(F.count("*").alias("fact_count"))
    sections = sections.withColumn("section_ordinal", F.row_number().over(Window.orderBy("section")).cast("long") - 1)
    inside = Window.partitionBy("p_type").orderBy("p_partkey")
    rows = t.part.select(F.col("p_type").alias("section"), "p_partkey", (F.row_number().over(inside).cast("long") - 1).alias("ordinal"))
    return rows.join(sections, "section")


@query("context_package", """
WITH s AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user' AND contains(text, 'tion')),
r AS (SELECT conv_id, turn, 1 AS priority FROM s UNION ALL
      SELECT c.conv_id, c.turn, 2 FROM conversations c JOIN s ON s.conv_id = c.conv_id AND abs(s.turn - c.turn) = 1),
m AS (SELECT conv_id, turn, min(priority) AS priority FROM r GROUP BY 1, 2),
k AS (SELECT conv_id, priority, turn, ceil(length(text) * 0.25)::BIGINT AS tokens FROM m JOIN conversations USING (conv_id, turn)),
u AS (SELECT conv_id, priority, turn, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY priority, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM k)
SELECT conv_id, count(*) AS items, max(upto) AS tokens, CASE WHEN max(upto) > 400 THEN 'budget_exceeded' ELSE 'ready' END AS status FROM u GROUP BY conv_id
""")
def context_package(t: Tables) -> DataFrame:
    """Seeds and their neighbours, each for its best reason; a budget that is exceeded is a status, never a cut."""
    c = t.conversations
    seeds = c.filter((F.col("role") == "user") & F.contains("text", F.lit("tion"))).select("conv_id", "turn").distinct()
    near = seeds.select("conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn")).distinct()
    reasons = seeds.withColumn("priority", F.lit(1)).unionByName(near.withColumn("priority", F.lit(2)))
    best = reasons.groupBy("conv_id", "turn").agg(F.min("priority").alias("priority"))
    items = c.join(best, ["conv_id", "turn"]).withColumn("tokens", F.ceil(F.length("text") * 0.25).cast("long"))
    total = items.groupBy("conv_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return total.withColumn("status", F.when(F.col("tokens") > 400, "budget_exceeded").otherwise("ready"))


@query("coverage_alignment", """
WITH planned AS (SELECT DISTINCT l_partkey AS s, l_returnflag AS f, l_linestatus AS x FROM lineitem WHERE l_quantity < 5),
seen AS (SELECT DISTINCT l_partkey AS s, l_returnflag AS f, l_linestatus AS x FROM lineitem WHERE l_quantity > 46)
SELECT *, 'missing' AS side FROM (FROM planned EXCEPT FROM seen) UNION ALL SELECT *, 'unexpected' FROM (FROM seen EXCEPT FROM planned)
""")
def coverage_alignment(t: Tables) -> DataFrame:
    keys = {"l_partkey": "s", "l_returnflag": "f", "l_linestatus": "x"}
    rows = lambda cond: t.lineitem.filter(cond).select(*keys).withColumnsRenamed(keys).distinct()
    planned, seen = rows("l_quantity < 5"), rows("l_quantity > 46")
    names = list(keys.values())
    return planned.join(seen, names, "left_anti").withColumn("side", F.lit("missing")).unionByName(seen.join(planned, names, "left_anti").withColumn("side", F.lit("unexpected")))


@query("positional_binding", """
WITH q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant')
SELECT conv_id, pos, q.turn AS rule_turn, a.turn AS case_turn FROM q FULL JOIN a USING (conv_id, pos)
""")
def positional_binding(t: Tables) -> DataFrame:
    def listed(role: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
        return t.conversations.filter(F.col("role") == role).select("conv_id", place.alias("pos"), F.col("turn").alias(name))

    return listed("user", "rule_turn").join(listed("assistant", "case_turn"), ["conv_id", "pos"], "full_outer")


@query("path_set_algebra", """
WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')
SELECT p, 'removed' AS kind FROM (FROM a EXCEPT FROM b) UNION ALL SELECT p, 'added' FROM (FROM b EXCEPT FROM a) UNION ALL SELECT p, 'kept' FROM (FROM a INTERSECT FROM b)
""")
def path_set_algebra(t: Tables) -> DataFrame:
    l = t.lineitem.select(F.col("l_partkey").alias("p"), "l_shipdate")  # noqa: E741
    old = l.filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select("p").distinct().withColumn("o", F.lit(1))
    new = l.filter(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")).select("p").distinct().withColumn("n", F.lit(1))
    kind = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").otherwise("kept")
    return old.join(new, "p", "full_outer").select("p", kind.alias("kind"))


@query("drift_propagation", """
SELECT DISTINCT o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)))
AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
""")
def drift_propagation(t: Tables) -> DataFrame:
    orders = progress.propagated(t.region.filter("r_regionkey < 2"), (t.nation, "n_regionkey", "r_regionkey"), (t.customer, "c_nationkey", "n_nationkey"), (t.orders, "o_custkey", "c_custkey"))
    lines = progress.propagated(t.supplier.filter("s_acctbal < 0"), (t.lineitem, "l_suppkey", "s_suppkey"))
    return orders.select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_suppkey").distinct()


@query("scenario_evidence", """
SELECT l_orderkey AS flow, bool_and(l_linestatus = 'F') AS passed, count(*) AS steps, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS evidence
FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity > 10)
""")
def scenario_evidence(t: Tables) -> DataFrame:
    out = progress.scenario_evidence(t.lineitem.withColumnRenamed("l_orderkey", "flow"), "flow", F.col("l_linestatus") == "F", "l_suppkey", F.col("l_quantity") > 10)
    return out.withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@query("publish_plan", """
WITH s AS (SELECT o_orderkey AS k, sha256(o_orderstatus) AS d FROM orders WHERE o_orderkey % 3 = 0),
i AS (SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END) AS d FROM orders WHERE o_orderkey % 2 = 0)
SELECT i.k AS fact_id, CASE WHEN s.k IS NULL THEN 'insert' WHEN s.d = i.d THEN 'replay' ELSE 'conflict' END AS action FROM i LEFT JOIN s ON s.k = i.k
""")
def publish_plan(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("fact_id"), "o_orderstatus")
    stored = o.filter("fact_id % 3 = 0").select("fact_id", F.sha2("o_orderstatus", 256).alias("digest"))
    content = F.when(F.col("fact_id") % 7 == 0, "new").otherwise(F.col("o_orderstatus"))
    incoming = o.filter("fact_id % 2 = 0").select("fact_id", F.sha2(content, 256).alias("digest"))
    return publishing.publish_plan(stored, incoming, "fact_id", "digest").select("fact_id", "action")


@query("build_status", """
WITH RECURSIVE e AS (SELECT o_orderkey AS build, o_orderstatus AS kind, o_custkey AS scope, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN [] WHEN o_orderkey % 997 = 1 THEN [-1] ELSE [o_orderkey - o_orderkey % 4] END AS needs FROM orders),
c AS (SELECT *, seq = max(seq) OVER (PARTITION BY kind, scope) AS current FROM e),
l AS (SELECT build, unnest(needs) AS needs FROM e),
s AS (SELECT build FROM c WHERE NOT current UNION SELECT build FROM l WHERE needs NOT IN (SELECT build FROM e) UNION SELECT l.build FROM l JOIN s ON l.needs = s.build)
SELECT build, kind, scope, current, CASE WHEN build IN (SELECT build FROM s) THEN 'stale' ELSE 'ready' END AS status FROM c
""")
def build_status(t: Tables) -> DataFrame:
    """Orders as builds of a status and customer that depend on an order before them."""
    k = F.col("o_orderkey")
    needs = F.when(k % 4 == 0, F.array().cast("array<bigint>")).when(k % 997 == 1, F.array(F.lit(-1).cast("long"))).otherwise(F.array(k - k % 4))
    events = t.orders.select(k.alias("build"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("scope"), k.alias("seq"), needs.alias("depends_on"))
    return ledger.build_status(events).drop("seq")


@query("accepted_appends", """
WITH l AS (SELECT user_id, max(event_id) AS latest FROM events GROUP BY 1), a AS (SELECT user_id, max(event_id) AS expected FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT user_id, expected, latest, expected = latest AS accepted FROM a JOIN l USING (user_id)
""")
def accepted_appends(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type")
    appends = e.filter("event_type <> 'error'").groupBy("user_id").agg(F.max("event_id").alias("expected"))
    return publishing.accepted_appends(e, appends, "user_id", "event_id")


@query("sequence_violations", """
WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS same FROM lineitem)
SELECT l_orderkey, CASE WHEN max(same) > 1 THEN 'duplicate_sequence' ELSE 'gap_in_sequence' END AS violation FROM n GROUP BY 1 HAVING max(same) > 1 OR bool_or(place <> l_linenumber)
""")
def sequence_violations(t: Tables) -> DataFrame:
    """Plans whose steps aren't numbered 1, 2, 3 ...: decided by counts, without ordering the steps."""
    s = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    kind = F.when(F.col("n") != F.col("d"), "duplicate_sequence").when((F.col("low") != 1) | (F.col("high") != F.col("n")), "gap_in_sequence")
    return s.select("l_orderkey", kind.alias("violation")).filter("violation is not null")


@query("integrity_check", """
WITH s AS (SELECT l_orderkey AS k, count(*) AS n, sha256(array_to_string(list_sort(list(l_partkey)), ',')) AS d FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS k, count(*) AS n, sha256(array_to_string(list_sort(list(CASE WHEN l_orderkey % 50 = 0 THEN l_partkey + 1 ELSE l_partkey END)), ',')) AS d FROM lineitem WHERE l_orderkey % 40 <> 0 GROUP BY 1)
SELECT s.k AS build, CASE WHEN c.k IS NULL THEN 'missing' WHEN c.n <> s.n THEN 'count' ELSE 'digest' END AS fault FROM s LEFT JOIN c ON c.k = s.k WHERE c.k IS NULL OR c.n <> s.n OR c.d <> s.d
""")
def integrity_check(t: Tables) -> DataFrame:
    def ledger(df: DataFrame, n: str, d: str) -> DataFrame:
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list("p")).cast("array<string>"), ","), 256)
        return df.groupBy("build").agg(F.count("*").alias(n), digest.alias(d))

    l = t.lineitem.select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("p"))  # noqa: E741
    now = l.filter("build % 40 <> 0").withColumn("p", F.when(F.col("build") % 50 == 0, F.col("p") + 1).otherwise(F.col("p")))
    both = ledger(l, "n", "d").join(ledger(now, "n2", "d2"), "build", "left")
    fault = F.when(F.col("n2").isNull(), "missing").when(F.col("n") != F.col("n2"), "count").when(F.col("d") != F.col("d2"), "digest")
    return both.select("build", fault.alias("fault")).filter("fault is not null")


_SECRET_SQL, _BEARER_SQL = (p.replace("'", "''") for p in (fn.SECRET, fn.BEARER))


@query("secret_redaction", f"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '{_SECRET_SQL}', '\\1\\2***', 'g'), '{_BEARER_SQL}', '\\1***', 'g')) AS digest,
       regexp_matches(t, '{_SECRET_SQL}') OR regexp_matches(t, '{_BEARER_SQL}') AS had_secret
FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Authorization: Bearer abc.def' WHEN 1 THEN ' {{"db": {{"client_secret": "x y", "dsn":"pg://u:p@h"}}}}' ELSE '' END AS t FROM documents)
""")
def secret_redaction(t: Tables) -> DataFrame:
    """Texts, some with a header or nested fields behind them, as they may be stored as evidence."""
    more = F.when(F.col("doc_id") % 3 == 0, " Authorization: Bearer abc.def").when(F.col("doc_id") % 3 == 1, ' {"db": {"client_secret": "x y", "dsn":"pg://u:p@h"}}').otherwise("")
    d = t.documents.select("doc_id", F.concat("text", more).alias("t"))
    had = F.col("t").rlike(fn.SECRET) | F.col("t").rlike(fn.BEARER)
    return d.select("doc_id", F.sha2(fn.redacted(F.col("t")), 256).alias("digest"), had.alias("had_secret"))


@query("readiness_summary", """
SELECT n_regionkey AS gate, count(*) AS cases, CASE WHEN bool_or(c_acctbal < -900) THEN 'blocked' WHEN bool_or(c_acctbal < -500) THEN 'needs_review' ELSE 'ready' END AS status
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey
""")
def readiness_summary(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumnRenamed("n_regionkey", "gate")
    low = lambda x: F.col("c_acctbal") < x
    return progress.folded_status(c, "gate", [("blocked", low(-900)), ("needs_review", low(-500))], "ready")


@query("rebuild_batches", """
SELECT o_orderkey, (o_orderkey % 5 + 1) * 10 AS phase, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5, o_orderkey) AS place,
       o_orderkey % 5 = min(o_orderkey % 5) OVER (PARTITION BY o_custkey) AS ready FROM orders WHERE o_orderstatus <> 'F'
""")
def rebuild_batches(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderstatus <> 'F'").withColumn("phase", (F.col("o_orderkey") % 5 + 1) * 10)
    return progress.rebuild_batches(o, "o_custkey", "phase", "o_orderkey").select("o_orderkey", "phase", "place", "ready")


@query("stale_run_recovery", """
SELECT user_id, max(ts) AS started_at, CASE WHEN max(ts) <= TIMESTAMP '2024-01-29' THEN 'recovered' ELSE 'running' END AS state FROM events WHERE event_type = 'signup' GROUP BY user_id
""")
def stale_run_recovery(t: Tables) -> DataFrame:
    return progress.recovered_runs(t.events.filter("event_type = 'signup'"), "user_id", "ts", "2024-01-29")


@query("target_classification", """
SELECT url, CASE WHEN url LIKE 'https:%' THEN 'secure' WHEN url LIKE 'http:%' THEN 'plain' ELSE 'unknown' END AS namespace,
       split_part(split_part(url, '://', 2), '/', 1) AS category, count(*) AS n FROM pages GROUP BY url
""")
def target_classification(t: Tables) -> DataFrame:
    return progress.url_kinds(t.pages, "url")


@query("event_sequences", "SELECT user_id, coalesce(max(event_id), 0) + 1 AS next_sequence, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def event_sequences(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_sequence"), F.countDistinct("event_type").alias("kinds"))
