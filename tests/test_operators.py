import pytest
from pyspark.sql import functions as F

from tessera.functions import conditions
from tessera.functions import text as fn
from tessera.operators import aggregates, graph, ranking, relevance, resolve
from tessera.streaming import state


def values(spark, column, rows):
    frame = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in frame.select(column(F.col("x")).alias("y")).collect()]


def test_text_functions(spark):
    assert values(spark, fn.normalized, ["  Ab　C ", "ＦＵＬＬ\tﬁ", None, ""]) == ["ab c", "full fi", None, ""]
    assert values(spark, fn.search_text, ["A-b é_1"]) == ["abé1"]
    assert values(spark, fn.bigrams, ["abab", "a", ""]) == [["ab", "ba"], [], []]
    assert values(spark, fn.token_estimate, ["abcde", "漢字", ""]) == [2, 2, 0]
    assert values(spark, lambda c: fn.stable_key("rule", c, F.lit("x/y")), ["a b*~", "", None]) == ["rule:a%20b%2A~/x%2Fy", None, None]
    assert values(spark, fn.url_path, ["https://h/a//b/?q", "c/", "/", "", "http://h"]) == ["/a/b", "/c", "/", "/", "/"]
    assert values(spark, fn.route_template, ["/a/{id}/:n/b"]) == ["/a/{*}/{*}/b"]
    assert values(spark, lambda c: fn.a1_row_col(c)["col"], ["AB12", "x"]) == [28, None]
    assert values(spark, fn.signature_arity, ["f(Map<String, List<A, B>> m, int n)", "f()", "f(int a)", "f(Map<K, A<B<C<D<E, F>>>>> m, int[] n, G<H, I> g)"]) == [2, 0, 1, 3]
    secrets = ["password = hunter2 ok", 'x {"db": {"clientId": 1, "client_secret": "a b", "n": 2}}', "Authorization: Bearer a.b-c, next", "see bearer xyz", "PWD:'q r' end", "api-key=1 dsn: u", "tokens: 5 secretary: b"]
    assert values(spark, fn.redacted, secrets) == ["password = *** ok", 'x {"db": {"clientId": 1, "client_secret": ***, "n": 2}}', "Authorization: ***, next", "see bearer ***", "PWD:*** end", "api-key=*** dsn: ***", "tokens: 5 secretary: b"]
    assert values(spark, fn.is_secret_name, ["clientSecret", "sessionId", "session_id", "secretary", "API-Key", "tokenCount"]) == [True, True, True, False, True, True]
    assert values(spark, fn.normalized, ["a\x1cb", "a\x1cbé", "a\x1f\x1e b"]) == ["a b", "a bé", "a b"]
    assert values(spark, fn.safe_path, ["a/b.txt", "../a", "/a", "a\\b", "a/..", "C:x"]) == [True, False, False, False, False, False]


@pytest.mark.parametrize(
    ("doc", "operator", "operands", "reason"),
    [
        ('{"a": 5}', "gt", (4,), "satisfied"), ('{"a": "5"}', "gt", (4,), "wrong_type"), ('{"a": true}', "gte", (0,), "wrong_type"),
        ('{"b": 5}', "exists", (), "missing_path"), ('{"a": null}', "exists", (), "satisfied"), ('{"a": "xyz"}', "contains", ("y",), "satisfied"),
        ('{"a": 5}', "between", (1, 4), "not_satisfied"), ('{"a": 5}', "in", (4, 5), "satisfied"), ('{"a": "q"}', "not_equals", ("q",), "not_satisfied"), ("no json", "exists", (), "missing_path"),
    ],
)
def test_conditions_fail_closed(spark, doc, operator, operands, reason):
    frame = spark.createDataFrame([(doc,)], "x string")
    row = frame.select(conditions.condition(F.col("x"), "$.a", operator, *operands).alias("c")).first()["c"]
    assert (row["passed"], row["reason"]) == (reason == "satisfied", reason)


def test_null_is_not_absent(spark):
    frame = spark.createDataFrame([('{"a": null}',), ('{"b": 1}',)], "x string")
    got = [tuple(r[0]) for r in frame.select(conditions.json_value(F.col("x"), "$.a")).collect()]
    assert [g[:2] for g in got] == [(True, True), (False, False)]


def test_rank_fusion_orders_by_score_then_id(spark):
    vector = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank long")
    keyword = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank long")
    rows = ranking.reciprocal_rank_fusion({"vector": vector, "keyword": keyword}, "id", 10).collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["score"] == 1.0 and rows[0]["channels"] == ["keyword", "vector"]


def test_keyword_grammar(spark):
    docs = spark.createDataFrame([(1, "Red fox, red dog"), (2, "red cat"), (3, "the fox red"), (4, None), (5, "blue")], "id long, text string")
    found = lambda q: [r["id"] for r in ranking.keyword_topk(docs, q, 10, "id", "text").orderBy("rank").collect()]
    assert found('"red fox"') == [1]
    assert set(found("red -cat")) == {1, 3}
    assert set(found("cat or blue")) == {2, 5}
    assert found("-red") == found("") == []


def test_snapshot_diff_ignores_equal_rows(spark):
    a = spark.createDataFrame([("k1", "x", None), ("k2", "y", "1"), ("k3", "z", "1")], "k string, v string, w string")
    b = spark.createDataFrame([("k1", "x", None), ("k2", "y", None), ("k4", "n", "1")], "k string, v string, w string")
    got = {r["k"]: (r["change_type"], r["changed_fields"]) for r in resolve.snapshot_diff(a, b, "k", ["v", "w"]).collect()}
    assert got == {"k2": ("modified", ["w"]), "k3": ("deleted", ["v", "w"]), "k4": ("added", ["v", "w"])}


def test_resolution_reasons(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (5, "e")], "id long, k string")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21), ("e", 5)], "k string, c long")
    got = {r["id"]: (r["reason"], r["target"], r["candidate_count"]) for r in resolve.resolve_unique(left, right, ["k"], "id", "c").collect()}
    assert got == {1: ("resolved", 10, 1), 2: ("ambiguous_target", None, 2), 3: ("missing_source_value", None, 0), 4: ("no_target", None, 0), 5: ("self_target", None, 1)}


def test_coverage_of_an_unknown_or_empty_file(spark):
    lines = lambda rows: spark.createDataFrame(rows, "path string, line int")
    out = aggregates.changed_line_coverage(lines([("a", 1), ("a", 2), ("b", 1), ("c", 9)]), lines([("a", 1), ("a", 2)]), lines([("a", 1)]), lines([("a", 1), ("c", 1)]))
    got = {r["path"]: (r["changed_lines"], r["covered_lines"], r["percent"], r["status"]) for r in out.collect()}
    assert got == {"a": (2, 1, 50.0, "failed"), "b": (1, 0, 0.0, "failed"), "c": (0, 0, 100.0, "passed")}


def test_cycles_are_reported(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 3), (5, 4)], "node long, needs long")
    assert {r["node"]: r["level"] for r in graph.topological_levels(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: -1, 4: -1, 5: -1}
    closure = graph.transitive_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))
    assert closure.count() == 9


def test_deep_chains_are_no_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 7)], "node long, needs long")
    assert {r["node"]: r["level"] for r in graph.topological_levels(nodes, edges).collect()} == {i: i for i in range(7)}
    with pytest.raises(RuntimeError):
        graph.topological_levels(nodes, edges, most_rounds=3)


def test_findings_are_closed_by_one_edge(spark):
    findings = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "c", "r"), (4, "d", "s"), (5, None, None)], "f long, x string, y string")
    edges = spark.createDataFrame([(10, "a", "z"), (20, "b", "q"), (21, "b", "z"), (30, "c", "z"), (31, "z", "r"), (32, None, None)], "e long, x string, y string")
    got = {r["f"]: (r["closed_by"], r["edge_count"]) for r in resolve.close_findings(findings, edges, "f", "e", ["x", "y"]).collect()}
    assert got == {1: (10, 1), 2: (None, 2), 3: (None, 2), 4: (None, 0), 5: (None, 0)}


def test_places_are_numbered_over_ranges(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("k"))
    order = [F.desc("k"), F.col("id")]
    got = {r["id"]: r["place"] for r in ranking.numbered(rows, order, "place").collect()}
    want = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert [got[i] for i in want] == list(range(1, 501))


def test_exact_quantile(spark):
    rows = [("a", float(x)) for x in range(101)] + [("b", 5.0)] * 30 + [("b", None), ("c", 1.0), ("c", 2.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    assert {r["k"]: round(r["q"], 9) for r in aggregates.exact_quantile(frame, "k", "v", 0.95, "q").collect()} == {"a": 95.0, "b": 5.0, "c": 1.95}
    assert aggregates.exact_quantile(frame.limit(0), "k", "v", 0.5, "q").count() == 0


def test_all_overlapping_sets_are_found(spark):
    import random

    rng = random.Random(3)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(0, 9))} for i in range(60)}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "i long, g array<long>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in aggregates.overlapping_sets(frame, "i", "g", 0.5).collect()} == want


def brute_density(tokens, groups):
    """The sum over shortest stretches that hold all wanted terms of an alternative, none shorter inside."""
    terms = {t for g in groups for wanted, t in g if wanted}
    groups = [[t for w, t in g if w] for g in groups if not any(not w and t in tokens for w, t in g)]
    holds = lambda part: any(all(t in part for t in g) for g in groups)
    total = 0.0
    for b in range(len(tokens)):
        for e in range(b, len(tokens)):
            part = tokens[b : e + 1]
            if holds(part) and not holds(part[1:]) and not holds(part[:-1]):
                total += 0.1 / (1 + sum(t not in terms for t in part))
    return total


def test_cover_density_agrees_with_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdxyz") for _ in range(rng.randrange(0, 14))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "i long, t array<string>")
    for query in ("a b", "a b -d", "a b or c", "a", "a b c or x -y"):
        groups = ranking.parse_keywords(query)
        got = {r["i"]: r["s"] for r in frame.select("i", relevance.cover_density(F.col("t"), groups).alias("s")).collect()}
        assert all(abs(got[i] - brute_density(t, groups)) < 1e-9 for i, t in rows), query


def test_subjects_and_operations(spark):
    assert values(spark, relevance.document_subject, ["01_画面設計書_経費一覧.v2.xlsx", "API詳細設計書_Ring-Search.docx", "", "9_x"]) == ["経費一覧v2", "ringsearch", "", "x"]
    assert values(spark, relevance.operation_signals, ["Please FILTER and 削除", "none"]) == [["search", "delete"], []]


def test_many_queries_find_their_nearest(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 4), (92, [1.0]), (93, [float("nan")] * 4), (94, x[3].tolist())]
    frame = spark.createDataFrame(rows, "i long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(q, x[q].tolist()) for q in (3, 7, 9)] + [(99, [0.0] * 4)], "q long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for size in (4_000_000, 40):  # one block, and a block for each query
        monkeypatch.setattr(ranking, "QUERY_BYTES", size)
        got = {(r["q"], r["rank"]): r["i"] for r in ranking.vector_topk_many(frame, queries, 5, "i", "q", "v").collect()}
        assert len(got) == 15 and got[3, 1] == 3 and got[3, 2] == 94
        for q in (7, 9):
            near = sorted([*range(60), 94], key=lambda i: (-np.clip(unit[q] @ unit[3 if i == 94 else i], 0, 1), i))[:5]
            assert [got[q, k] for k in range(1, 6)] == near


def test_streams_reach_the_batch_result(spark, tmp_path):
    events = spark.createDataFrame([(i % 5, i, f"s{i % 3}") for i in range(60)], "key long, seq long, status string")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = state.latest_state(stream, "key", ["seq"], ["status", "seq"]).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    run.awaitTermination(60)
    want = state.latest_state(events, "key", ["seq"], ["status", "seq"])
    assert {tuple(r) for r in spark.table("latest").collect()} == {tuple(r) for r in want.collect()}


def test_replays_are_dropped_in_a_stream(spark, tmp_path):
    rows = spark.sql("select id % 10 as event_id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id % 10, 0) as ts from range(30)")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = state.replay_safe(stream, "event_id", "ts").writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("once").count() == 10
    assert state.replay_safe(rows, "event_id", "ts").count() == 10


def test_leases_in_a_stream(spark, tmp_path):
    schema = "task_id long, claim_id string, at timestamp, lease_seconds int, released boolean"
    batches = [
        [(1, "a", "2024-01-01 00:00:00", 60, False), (1, "b", "2024-01-01 00:00:30", 60, False), (2, "c", "2024-01-01 00:00:00", 600, False)],
        [(1, "a", "2024-01-01 00:00:50", 60, False), (2, "c", "2024-01-01 00:01:00", 0, True), (2, "d", "2024-01-01 00:01:10", 60, False)],
        [(3, "z", "2024-01-01 02:00:00", 60, False)],
        [(3, "z", "2024-01-01 02:00:30", 60, False)],
    ]
    run = None
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "task_id long, claim_id string, at string, lease_seconds int, released boolean")
        frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = state.lease_events(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
        run = out.trigger(availableNow=True).start()
        run.awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, "a", "claimed"), (1, "b", "rejected"), (1, "a", "renewed"), (1, "a", "expired"), (2, "c", "claimed"), (2, "c", "released"), (2, "d", "claimed"), (2, "d", "expired"), (3, "z", "renewed")} <= got


def test_sources_must_be_linked(spark):
    rows = [(1, "db", "id", "7"), (1, "api", "id", "7"), (1, "api", "name", "x"), (1, "ui", "name", "x"), (2, "db", "id", "1"), (2, "ui", "id", "2"), (3, "db", "id", None)]
    frame = spark.createDataFrame(rows, "case long, source string, name string, value string")
    got = {r["case"]: (r["sources"], r["connected"]) for r in graph.same_record(frame, "case", "source", "name", "value").collect()}
    assert got == {1: (3, True), 2: (2, False), 3: (1, True)}


def test_an_excluded_word_costs_little(spark):
    """Flags of exclusion are found once for a text, not once for each place of a term."""
    import time

    rows = [(i, "the stone and river " * 5_000) for i in range(8)]
    docs = spark.createDataFrame(rows, "id int, text string").cache()
    docs.count()
    took = {}
    for query in ("the and", "the and -loser", "the and", "the and -loser"):
        began = time.time()
        assert len(ranking.keyword_topk(docs, query, 10, "id", "text").collect()) == 8
        took[query] = time.time() - began
    assert took["the and -loser"] < 2 * took["the and"] + 0.5


def test_conditions_that_count_or_compare_paths(spark):
    doc = '{"l": [1, 2, null], "o": {"a": 1}, "t": "éab", "n": 3, "d": 1.5, "b": true, "x": {"q": [1, {"z": 2}]}, "y": {"q": [1, {"z": 2}]}, "m": 3.0, "e": []}'
    ask = lambda path, op, operand: tuple(spark.range(1).select(conditions.condition(F.lit(doc), path, op, operand).alias("c")).first()["c"])
    counts = {"$.l": 3, "$.o": 1, "$.t": 3, "$.n": 3, "$.e": 0}
    assert all(ask(p, "count_equals", n) == (True, "satisfied") and ask(p, "count_equals", n + 1) == (False, "not_satisfied") for p, n in counts.items())
    assert ask("$.b", "count_equals", 1) == ask("$.d", "count_equals", 1) == (False, "wrong_type") and ask("$.none", "count_equals", 0) == (False, "missing_path")
    assert ask("$.x.q", "equals_path", "$.y.q") == ask("$.n", "equals_path", "$.m") == (True, "satisfied")
    assert ask("$.n", "equals_path", "$.t") == (False, "not_satisfied") and ask("$.n", "equals_path", "$.none") == (False, "wrong_type")


def test_nfkc_agrees_with_python(spark):
    import re
    import unicodedata

    texts = ["plain  Text\t\n x", "ﬁ ＡＢＣ　①②", "Straße İstanbul ΑΣ", "é é", "ｶﾞ 株式会社 ㍿", " \xa0 a b ", "", "½ ﷺ K Å"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fn.nfkc_folded(F.col("t"))).collect()]
    assert got == [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().casefold() for t in texts]


def test_vectors_away_from_the_query_are_ranked_by_cosine(spark):
    frame = spark.createDataFrame([(1, [-1.0, 0.1]), (2, [-1.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 1.0]), (5, [-1.0, 3.0])], "i long, v array<double>")
    got = [(r["i"], r["rank"]) for r in ranking.vector_topk(frame, [1.0, 0.0], 4, "i", "v").orderBy("rank").collect()]
    assert got == [(3, 1), (4, 2), (5, 3), (2, 4)]
    assert [r["score"] for r in ranking.vector_topk(frame, [1.0, 0.0], 5, "i", "v").orderBy("rank").collect()][1:] == [0.0] * 4


@pytest.mark.parametrize("kind", ["opposite", "multiples"])
def test_hybrid_search_agrees_with_its_sql(spark, tmp_path, kind):
    """Vectors away from the query; multiples of one vector, whose cosines differ by rounding alone."""
    import duckdb
    import numpy as np

    from tessera import plans

    rng = np.random.default_rng(1)
    asked = rng.normal(size=64).astype("f4")
    other = lambda i: rng.normal(size=64) - asked if kind == "opposite" else asked * np.float32(i % 7 + 1)
    vectors = [(0, asked.tolist())] + [(i, np.float32(other(i)).tolist()) for i in range(1, 300)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = [(1000 + i, f"the and {'x ' * i} the") for i in range(3)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute("SET threads = 1")
    for table in ("embeddings", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    for name in ("vector_topk", "hybrid_rrf"):
        got = {tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == set(db.execute(plans.ORACLES[name]).fetchall()), name
