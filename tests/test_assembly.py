from pyspark.sql import functions as F

from tessera.operators import assembly


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_sides_of_a_change_may_be_missing(spark):
    changes = spark.createDataFrame([(1, "s", "t", "k1"), (2, "s", "t", "k2"), (3, "s", "t", "k3")], "change_id int, source_snapshot string, target_snapshot string, stable_key string")
    facts = spark.createDataFrame([("s", "k1", "a"), ("t", "k1", "b"), ("t", "k2", "c"), ("u", "k3", "d")], "snapshot_id string, stable_key string, values string")
    assert got(assembly.change_sides(changes, facts), "change_id", "before", "after") == [(1, "a", "b"), (2, None, "c"), (3, None, None)]


def test_labels_come_from_both_ends(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "n string")
    relations = spark.createDataFrame([("a", "b", "y"), ("b", "a", "x"), ("b", "b", "x")], "s string, t string, l string")
    assert got(assembly.labelled(nodes, relations, "n", "s", "t", "l"), "n", "labels") == [("a", ["x", "y"]), ("b", ["x", "y"]), ("c", [])]


def test_members_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, '{"a": ["x", "x", null, "y"]}'), (2, '{"a": "x"}'), (3, "no json"), (4, None), (5, '{"b": []}')], "i int, d string")
    assert got(assembly.members_of_json(docs, "i", "d", "$.a"), "i", "member") == [(1, "x"), (1, "y")]


def test_a_data_set_is_proven_by_all_its_steps(spark):
    data = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("d4",)], "data_id string")
    steps = spark.createDataFrame([("f", "s1", "d1", 1), ("f", "s2", "d1", 2), ("f", "s3", "d2", 0), ("g", "s4", "d3", 1)], "flow_id string, step_id string, data_id string, assertions int")
    results = spark.createDataFrame([("s1", "passed", "e1"), ("s2", "passed", "e2"), ("s3", "passed", "e3"), ("s4", "passed", "e4"), ("s4", "failed", "e5")], "step_id string, status string, evidence_ref string")
    out = got(assembly.data_traces(data, steps, results), "data_id", "status", "evidence_refs")
    assert out == [("d1", "proven", ["e1", "e2"]), ("d2", "unproven", ["e3"]), ("d3", "failed", ["e4", "e5"]), ("d4", "unmapped", None)]


def test_flow_rules(spark):
    steps = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "x", 3), ("c", " ", 1), ("d", "x", 1), ("d", "y", 1)], "f string, s string, q int")
    assert got(assembly.flow_violations(steps, "f", "s", "q"), "f", "rule") == [("b", "sequence_gap"), ("b", "step_id_repeated"), ("c", "step_id_blank"), ("d", "sequence_repeated")]


def test_stages_and_recovery(spark):
    flows = spark.createDataFrame([("a", True, None, False), ("b", True, True, False), ("c", None, True, True)], "k string, x boolean, y boolean, held boolean")
    assert got(assembly.next_stage(flows, "k", [("one", F.col("x")), ("two", F.col("y"))], F.col("held")), "k", "next_stage", "action") == [("a", "two", "run"), ("b", None, "close"), ("c", "one", "wait_for_review")]
    out = assembly.recovery_order(flows, "k", [("held", F.col("held")), ("open", F.col("y").isNull())], "k", 1).collect()
    assert [(r["k"], r["recovery_class"]) for r in out] == [("c", "held")]


def test_inputs_are_bound_to_the_profile(spark):
    nodes = spark.createDataFrame([(1, ["b", "a"], "c", "s"), (2, ["a", "b"], "c", "s"), (3, None, None, None)], "node_id int, business_keys array<string>, content string, summary string")
    one = {r["node_id"]: r for r in assembly.embedding_inputs(nodes, "v1").collect()}
    other = {r["node_id"]: r["input_digest"] for r in assembly.embedding_inputs(nodes, "v2").collect()}
    assert one[1]["input_digest"] == one[2]["input_digest"] != other[1] and one[1]["keywords"] == "s\nc\na\nb"
    assert one[3]["text"] == '{"business_keys":[],"content":"","summary":""}'


def test_a_scan_has_each_row_once(spark):
    files = spark.createDataFrame([("a", "h")] * 2, "path string, content_hash string")
    symbols = spark.createDataFrame([("s", "a", "type", "T")], "symbol_id string, path string, symbol_type string, name string")
    edges = spark.createDataFrame([("calls", "s", "t", "a", "resolved"), ("calls", "s", "t", "a", "resolved")], "edge_type string, from_ref string, to_ref string, path string, resolution_status string")
    assert got(assembly.graph_rows(files, symbols, edges, "v"), "kind", "detail") == [("edge", "calls:resolved"), ("file", "h"), ("symbol", "type:T")]


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
        return shuffled_rows(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_facts_of_nodes_without_a_shuffle_of_pairs(spark, monkeypatch):
    nodes = [(i, "s", i % 2, ["a", "b", None, "a"] if i % 3 else ["b", "x"]) for i in range(300)] + [(7, "s", 1, ["x"]), (900, "s", None, ["a"]), (901, "s", 0, None), (None, "s", 0, ["a"]), (902, "s", 0, [f"w{k}" for k in range(40)])]
    facts = [(f"f{i}", 10 + i % 3, "ab"[i % 2]) for i in range(300)] + [("f1", 10, "a"), ("f1", 11, "b"), ("f1", 10, None), ("f1", None, "a"), (None, 10, "a"), *[("g", 10, f"w{k}") for k in range(40)], ("h", 10, "w1"), ("h", 10, "w2"), *[("v", 10 + k, "b") for k in range(30)]]
    versions = {0: [10, 12], 1: [11, 10]}
    want = {(n, f) for n, s, d, ks in nodes for v in versions.get(d, []) for k in ks or [] if k is not None for f, fv, fk in facts if (fv, fk) == (v, k)}
    n = spark.createDataFrame(nodes, "node_id int, snapshot_id string, document_id int, business_keys array<string>")
    f = spark.createDataFrame(facts, "fact_ref string, version_id int, stable_key string")
    m = spark.createDataFrame([("s", d, v) for d, vs in versions.items() for v in vs] + [("t", 0, 11)], "snapshot_id string, document_id int, version_id int")
    for pairs in (20_000_000, 1000):  # also with nodes dealt over several tasks
        monkeypatch.setattr(assembly, "PAIRS", pairs)
        out = assembly.facts_by_business_key(n, f, m)
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == len(set(rows)) == len(want) > 40_000 and set(rows) == want
        assert 1000 < shuffled_rows(out._jdf.queryExecution().executedPlan()) < 20_000
