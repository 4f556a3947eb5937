import pytest
from pyspark.sql import functions as F

from tessera.operators import records, unresolved, verdicts


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [
        ("a/spec.xlsx", "Top", 1, 1, "A1", "System"), ("a/spec.xlsx", "Top", 1, 2, "B1", "Billing"),
        ("a/spec.xlsx", "Items", 1, 1, "A1", "a note alone"),
        ("a/spec.xlsx", "Items", 3, 1, "A3", "Item ID"), ("a/spec.xlsx", "Items", 3, 3, "C3", "name"),
        ("a/spec.xlsx", "Items", 4, 1, "A4", "7"), ("a/spec.xlsx", "Items", 4, 2, "B4", "of no column"), ("a/spec.xlsx", "Items", 4, 3, "C4", "Pen"),
        ("a/spec.xlsx", "Items", 5, 3, "C5", "No key"), ("a/spec.xlsx", "Items", 6, 1, "A6", " "),
        ("a/spec.xlsx", "Items", 9, 1, "A9", "System"), ("a/spec.xlsx", "Items", 9, 2, "B9", "ITEM id"),
        ("a/spec.xlsx", "Items", 10, 1, "A10", "Stock"), ("a/spec.xlsx", "Items", 10, 2, "B10", "8"),
    ]
    return spark.createDataFrame(rows, "path string, sheet string, row int, col int, ref string, value string")


ALIASES = [("item id", "id"), ("Name", "name"), ("system", "system")]


def test_records_take_headers_context_and_places(spark, sheet):
    aliases = spark.createDataFrame(ALIASES, "alias string, field string")
    out = got(records.scan_records(sheet, aliases), "row", "field", "value", "source_ref", "inherited")
    assert out == sorted([
        (4, "id", "7", "spec.xlsx#Items!A4", False), (4, "name", "Pen", "spec.xlsx#Items!C4", False), (4, "system", "Billing", "spec.xlsx#Top!B1", True),
        (5, "name", "No key", "spec.xlsx#Items!C5", False), (5, "system", "Billing", "spec.xlsx#Top!B1", True),
        (10, "system", "Stock", "spec.xlsx#Items!A10", False), (10, "id", "8", "spec.xlsx#Items!B10", False),
    ], key=str)
    facts, bad = records.record_facts(records.scan_records(sheet, aliases), "item", ["system", "id"])
    assert got(facts, "stable_key") == [("item:Billing/7",), ("item:Stock/8",)]
    assert got(bad, "row", "reason") == [(5, "missing_key")]
    assert records.scan_records(sheet.limit(0), aliases).count() == 0


def test_document_diff(spark, sheet):
    aliases = spark.createDataFrame(ALIASES, "alias string, field string")
    later = sheet.withColumn("value", F.when(F.col("ref") == "C4", "Pencil").otherwise(F.col("value"))).filter("row <> 10")
    out = got(records.document_diff(sheet, later, aliases, "item", ["system", "id"]), "stable_key", "change_type", "field", "before", "after")
    assert out == [("item:Billing/7", "modified", "name", "Pen", "Pencil"), ("item:Stock/8", "deleted", "id", "8", None), ("item:Stock/8", "deleted", "system", "Stock", None)]
    same = records.document_diff(sheet, sheet.orderBy(F.desc("ref")), aliases, "item", ["system", "id"])
    assert same.count() == 0


def test_equal_keys_with_other_values_conflict(spark):
    rows = [("p", "s", r, f, v, f"p#s!{f}{r}", False) for r, f, v in ((1, "id", "1"), (1, "x", "a"), (2, "id", "1"), (2, "x", "b"), (3, "id", "2"), (4, "id", "2"), (5, "id", "3"), (5, "id", "4"))]
    frame = spark.createDataFrame(rows, "path string, sheet string, row int, field string, value string, source_ref string, inherited boolean")
    facts, bad = records.record_facts(frame, "t", ["id"])
    assert got(facts, "stable_key", "source_refs") == [("t:2", ["p#s!id3", "p#s!id4"])]
    assert got(bad, "row", "reason") == [(1, "conflicting_records"), (2, "conflicting_records"), (5, "conflicting_field")]


def test_cell_references(spark):
    frame = spark.createDataFrame([(1, 1), (12, 26), (3, 27), (4, 54), (5, 702), (6, 703), (7, 16384), (8, 18278), (9, 18279)], "r int, c int")
    assert [r[0] for r in frame.select(records.a1(F.col("r"), F.col("c"))).collect()] == ["A1", "Z12", "AA3", "BB4", "ZZ5", "AAA6", "XFD7", "ZZZ8", "AAAA9"]


def test_what_runtime_observations_prove(spark):
    observed = [("o1", "get", "/users/7", "r1"), ("o2", "GET", "/users/7", None), ("o3", "GET", "/x", "r9"), ("o4", "GET", "/x", "r2"), ("o5", "GET", "/x", "r3"), ("o6", "POST", "/users/7", "r1"), ("o7", "GET", "/none/here", "r4"), ("o8", "GET", "/both/1", "r5"), ("o9", "GET", "/users/1", "r6"), ("o10", "GET", "/teams/1", "r6")]
    o = spark.createDataFrame(observed, "observation_id string, method string, path string, source_route_ref string")
    routes = spark.createDataFrame([(f"r{i}", "GET") for i in range(1, 7)], "route_ref string, route_method string")
    edges = spark.createDataFrame([("e1", "r1"), ("e3a", "r3"), ("e3b", "r3"), ("e4", "r4"), ("e5", "r5"), ("e6", "r6")], "edge_id string, from_ref string")
    ends = spark.createDataFrame([("u", "GET", "/users/{id}"), ("t", "ANY", "/teams/:id"), ("b1", "GET", "/both/{x}"), ("b2", "ANY", "/both/1"), ("p", "POST", "/none/here")], "endpoint_ref string, method string, template string")
    out = {r["observation_id"]: (r["status"], r["reason"], r["endpoint_ref"], r["candidates"]) for r in unresolved.reconcile_routes(o, routes, edges, ends).collect()}
    assert out == {
        "o1": ("resolved", "resolved_unique", "u", ["u"]), "o2": ("unresolved", "missing_source_route_ref", None, []), "o3": ("unresolved", "source_route_not_found", None, []),
        "o4": ("unresolved", "source_route_not_unresolved", None, []), "o5": ("unresolved", "source_route_ambiguous", None, []), "o6": ("unresolved", "method_mismatch", None, []),
        "o7": ("unresolved", "endpoint_not_found", None, []), "o8": ("unresolved", "endpoint_ambiguous", None, ["b1", "b2"]),
        "o9": ("unresolved", "source_maps_multiple_endpoints", None, ["t", "u"]), "o10": ("unresolved", "source_maps_multiple_endpoints", None, ["t", "u"]),
    }


def test_reasons_of_open_edges(spark):
    targets = ["unresolved:call:a.run/1", "unresolved:call:run", "unresolved:table:Users", "external:x", "unresolved:endpoint:dynamic:q", "unresolved:route:dynamic:q", "unresolved:endpoint:http:GET:/u/1", "odd", "unresolved:entity:User"]
    rows = [(i, "navigates_to" if t == "odd" else "calls", "f", t, "unresolved", "x", "1", "p", 1, 2, "s1" if i == 0 else None) for i, t in enumerate(targets)] + [(99, "calls", "f", "t", "resolved", "x", "1", "p", 1, 2, None)]
    edges = spark.createDataFrame(rows, "edge_id int, edge_type string, from_ref string, to_ref string, resolution_status string, extractor string, profile_version string, path string, start_line int, end_line int, static_edge_ref string")
    symbols = spark.createDataFrame([("m1", "method", "run", "run(int a)"), ("m2", "method", "run", "run(Map<A, B> a)"), ("m3", "method", "run", "run()"), ("t", "db_table", "x", "table:users"), ("c", "class", "app.User", "")], "symbol_id string, symbol_type string, name string, signature string")
    ends = spark.createDataFrame([("u", "ANY", "/u/{id}")], "endpoint_ref string, method string, template string")
    out = {r["edge_id"]: (r["category"], r["reason"], r["candidates"]) for r in unresolved.unresolved_report(edges, symbols, ends).collect()}
    assert out == {
        0: ("call_target", "target_ambiguous", ["m1", "m2"]), 1: ("call_target", "target_ambiguous", ["m1", "m2", "m3"]), 2: ("data_table", "unresolved_reference", ["t"]),
        3: ("generic_relation", "external_reference_unverified", []), 4: ("endpoint_route", "runtime_observation_missing", []), 5: ("navigation_target", "dynamic_reference", []),
        6: ("endpoint_route", "unresolved_reference", ["u"]), 7: ("navigation_target", "target_definition_missing", []), 8: ("entity_mapping", "unresolved_reference", ["c"]),
    }
    keys = {r["edge_id"]: r["finding_key"] for r in unresolved.unresolved_report(edges, symbols, ends).collect()}
    assert keys[0] == "edge:s1" and len(set(keys.values())) == len(targets)


def test_calls_are_followed_through_receivers(spark):
    types = spark.createDataFrame([("a.A", "A", "a"), ("a.B", "B", "a"), ("b.B", "B", "b"), ("c.C", "C", "c")], "fqn string, simple string, package string")
    fields = spark.createDataFrame([("a.A", "b", "B"), ("a.A", "c", "C[]"), ("a.A", "lib", "Lib")], "owner string, name string, type string")
    imports = spark.createDataFrame([("a.A", "Lib", "org.Lib")], "owner string, simple string, fqn string")
    methods = spark.createDataFrame([("A.run0", "a.A", "run", 0, "B"), ("B.go1", "a.B", "go", 1, "C"), ("bB.go1", "b.B", "go", 1, "C"), ("C.end0", "c.C", "end", 0, None), ("C.two0", "c.C", "two", 0, "A"), ("C.two0b", "c.C", "two", 0, "A")], "method_id string, owner string, name string, arity int, returns string")
    chain = "array<struct<name:string,arity:int>>"
    calls = [
        (1, "a.A", None, "run", 0, None), (2, "a.A", "this.b", "go", 1, None), (3, "a.A", "b", "go", 2, None), (4, "a.A", "lib", "x", 0, None), (5, "a.A", "C", "end", 0, None), (6, "c.C", "B", "go", 1, None),
        (7, "a.A", None, "end", 0, [("run", 0), ("go", 1)]), (8, "a.A", "c", "run", 0, [("two", 0)]), (9, "a.A", "nobody", "run", 0, None), (10, "a.A", "c", "two", 0, None),
    ]
    frame = spark.createDataFrame(calls, f"call_id int, owner string, receiver string, name string, arity int, chain {chain}")
    out = {r["call_id"]: (r["status"], r["target"], r["candidate_count"]) for r in unresolved.resolve_calls(frame, methods, fields, types, imports).collect()}
    assert out == {
        1: ("resolved", "A.run0", 1), 2: ("resolved", "B.go1", 1), 3: ("unresolved", None, 0), 4: ("external", None, 0), 5: ("resolved", "C.end0", 1), 6: ("unresolved", None, 0),
        7: ("resolved", "C.end0", 1), 8: ("unresolved", None, 0), 9: ("unresolved", None, 0), 10: ("unresolved", None, 2),
    }


def test_tables_in_sql_files(spark):
    text = "select * from Users u\njoin \"Orders\" o on 1=1;\ncreate table if not exists users (id int);\ninsert into log values (1); update USERS set x = 1"
    tables, uses = unresolved.sql_table_refs(spark.createDataFrame([("a.sql", text), ("b.sql", None)], "path string, text string"))
    assert got(tables, "table", "line", "is_definition") == [("log", 4, False), ("orders", 2, False), ("users", 3, True)]
    assert got(uses, "table", "access", "line") == [("log", "writes", 4), ("orders", "reads", 2), ("users", "reads", 1), ("users", "writes", 3), ("users", "writes", 4)]


def test_changes_of_a_diff(spark):
    status = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("D\tgone.py",), ("",), ("A\tb c.py",)], "line string")
    assert got(unresolved.changed_files(status), "change", "path", "old_path") == [("added", "b c.py", None), ("deleted", "gone.py", None), ("modified", "a.py", None), ("renamed", "new.py", "old.py")]
    text = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,0 +2,3 @@ x\n+1\n+2\n+3\n@@ -9 +12 @@\n-a\n+b\n@@ -20,2 +22,0 @@\ndiff --git a/g b/g\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-x"
    diff = spark.createDataFrame(list(enumerate(text.split("\n"))), "pos int, line string")
    assert got(unresolved.changed_lines(diff), "path", "line") == [("a.py", 12), ("a.py", 2), ("a.py", 3), ("a.py", 4)]


def test_small_functions(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first()["x"]
    variables = F.create_map(F.lit("a"), F.lit("1"), F.lit("b_2"), F.lit("$x"))
    assert ask(verdicts.substituted(F.lit("/u/${a}/${b_2}/${a}"), variables)) == "/u/1/$x/1"
    assert ask(verdicts.substituted(F.lit("${none}"), variables)) is None
    assert [ask(verdicts.satisfies(F.lit(3), F.lit(p))) for p in (">= 3", ">3", "!=2", "= 3.0", "< 1", "about 3")] == [True, False, True, True, False, None]
    assert ask(verdicts.normalized_key(F.lit("aß"), "casefold")) == "ass" and ask(verdicts.normalized_key(F.lit("aB"), "preserve")) == "aB"
    digest = lambda keys: ask(verdicts.node_digest(F.lit("rule"), F.array(*map(F.lit, keys)), F.lit("s"), F.lit("c")))
    assert digest(["a", "b"]) == digest(["b", "a"]) != digest(["ab"])
    texts = ask(verdicts.query_texts(F.lit("raise limit"), F.array(F.lit("k2"), F.lit("k1")), F.array(F.lit("x"), F.lit("y"))))
    assert [t["text"] for t in texts] == ["Business change: raise limit", "Anchors: k1, k2", "Acceptance: - x\n- y"]


def test_scopes_and_thresholds(spark):
    rows = spark.createDataFrame([("p", 1, "run.a"), ("p", 2, "run.b"), ("q", 1, "stop")], "project string, n int, action string")
    assert verdicts.scoped(rows, project="p", n=None).count() == 2
    assert verdicts.scoped(rows, ("action", "run."), n=[1, 3]).count() == 1
    metrics = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.5, 0.2), ("c", 1.0, 0.0), ("d", None, None)], "case string, recall double, irrelevant double")
    leaks = spark.createDataFrame([("c",), ("c",)], "case string")
    out = got(verdicts.retrieval_verdict(metrics, leaks, "case", recall=0.9, max_irrelevant=0.0), "case", "verdict", "failed")
    assert out == [("a", "passed", []), ("b", "failed", ["max_irrelevant", "recall"]), ("c", "failed", ["project_leak"]), ("d", "failed", ["recall"])]


def test_claims_need_their_own_sources(spark):
    none = []
    claims = [(1, "code_test", ["t1"], ["c1"], none, none), (2, "code_test", ["t1"], none, none, none), (3, "code_test", ["t1"], ["c1"], ["a1"], none), (4, "command_evidence", none, ["c1", "c9"], none, none), (5, "command_evidence", none, ["c1"], none, none), (6, "canonical_evidence", none, none, ["a1"], none), (7, "plan", None, None, None, ["x1"]), (8, "plan", none, none, none, none)]
    frame = spark.createDataFrame(claims, "claim_id int, kind string, test_files array<string>, commands array<string>, artifacts array<string>, components array<string>")
    refs = lambda *x: spark.createDataFrame([(v,) for v in x], "ref string")
    out = verdicts.claim_verdicts(frame, refs("t1"), refs("c1"), refs("a1"), refs("x1"))
    assert got(out.filter("valid"), "claim_id") == [(1,), (5,), (6,), (7,)]


def test_missing_evidence_blocks(spark):
    cases = spark.createDataFrame([(1, "unit", True), (2, "ui", False), (3, "unit", False)], "case_id int, level string, data_required boolean")
    none = spark.createDataFrame([], "case_id int, status string, evidence_refs array<string>")
    edit = spark.createDataFrame([], "committed boolean, result_refs array<string>, passed boolean")
    assert got(verdicts.test_results(cases, none, none, edit), "case_id", "status") == [(1, "blocked"), (2, "blocked"), (3, "blocked")]
    flows = spark.createDataFrame([(1, "passed", ["f2", "f1"]), (1, "passed", ["f1"])], none.schema)
    done = spark.createDataFrame([(True, ["r"], True)], edit.schema)
    out = {r["case_id"]: (r["status"], r["evidence_refs"]) for r in verdicts.test_results(cases, flows, none, done).collect()}
    assert out == {1: ("passed", ["f1", "f2", "r"]), 2: ("blocked", []), 3: ("passed", ["r"])}


def test_only_definitions_count_where_there_are_some(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    c = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False), ("c", 4, False), ("c", 5, False)], "name string, id int, is_def boolean")
    assert got(unresolved.preferred_targets(names, c, "name", "id", "is_def"), "name", "target", "candidate_count") == [("a", 1, 1), ("b", 3, 1), ("c", None, 2), ("d", None, 0)]


def test_bindings_take_the_best_edge(spark):
    edges = spark.createDataFrame([("e1", "tests", "resolved", "t", "p", "low"), ("e2", "tests", "resolved", "p", "t", "high"), ("e3", "tests", "resolved", "t", "t", "high"), ("e4", "calls", "resolved", "t", "p", "high")], "edge_id string, edge_type string, resolution_status string, from_ref string, to_ref string, confidence string")
    owners = spark.createDataFrame([("t", "T", "test"), ("p", "P", "source")], "ref string, file_id string, role string")
    assert got(unresolved.test_bindings(edges, owners, "s"), "production_file", "test_file", "edge_id") == [("P", "T", "e2")]


def test_profiles_that_tie_need_a_review(spark):
    scores = spark.createDataFrame([("a", "p", 0.9, True), ("a", "q", 0.9 - 1e-12, True), ("b", "p", 0.9, True), ("b", "q", 0.8, True), ("c", "p", 0.4, False), ("d", "p", 0.0, False)], "document string, profile string, score double, automatic boolean")
    assert got(verdicts.match_profiles(scores), "document", "outcome", "profile") == [("a", "review", None), ("b", "matched", "p"), ("c", "review", None), ("d", "ignored", None)]


def test_tables_on_the_line_after_their_keyword(spark):
    text = "insert into\n  audit select * from\r\n\n  orders o\n join \"Lines\" l;\ncreate table if not\nexists Audit (x int);\n-- \x01\x02\nUPDATE t1 set a = 1"
    tables, uses = unresolved.sql_table_refs(spark.createDataFrame([("a.sql", text), ("b.sql", None), ("c.sql", "")], "path string, text string"))
    assert got(uses, "table", "access", "line") == [("audit", "writes", 1), ("audit", "writes", 6), ("lines", "reads", 5), ("orders", "reads", 2), ("t1", "writes", 9)]
    assert got(tables, "table", "line", "is_definition") == [("audit", 6, True), ("lines", 5, False), ("orders", 2, False), ("t1", 9, False)]
