from pyspark.sql import functions as F

from tessera.operators import progress


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_capabilities_of_a_list_or_of_each_row(spark):
    rows = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, ["a", "c"], ["a"]), (3, None, []), (4, [], None)], "i int, needs array<string>, offers array<string>")
    assert got(progress.capable(rows, F.col("needs"), ("a", "b")), "i") == [(1,), (3,), (4,)]
    assert got(progress.capable(rows.filter("offers is not null"), F.col("needs"), offers=F.col("offers")), "i") == [(1,), (3,)]


def test_stages_after_an_open_one_wait(spark):
    rows = spark.createDataFrame([("a", 1, "completed"), ("a", 2, "failed"), ("a", 3, "completed"), ("b", 1, "completed"), ("b", 2, "running")], "k string, s int, state string")
    assert got(progress.stage_states(rows, "k", "s", "state"), "k", "s", "shown_state") == [("a", 1, "completed"), ("a", 2, "failed"), ("a", 3, "waiting"), ("b", 1, "completed"), ("b", 2, "running")]
    assert got(progress.stage_progress(rows, "k", "s", F.col("state") == "completed"), "k", "done", "stages", "current_stage", "percent") == [("a", 2, 3, 2, 67.0), ("b", 1, 2, 2, 50.0)]


def test_criteria_without_a_condition_that_applies_are_not_covered(spark):
    rows = spark.createDataFrame([("a", True, True), ("a", False, False), ("b", None, True), ("c", True, False)], "c string, ok boolean, applies boolean")
    assert got(progress.criterion_coverage(rows, "c", F.col("ok"), F.col("applies")), "c", "n_conditions", "covered", "n_failed") == [("a", 1, True, 0), ("b", 1, False, 1), ("c", 0, False, 0)]


def test_the_gravest_level_decides(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 9), ("b", 5), ("c", None)], "k string, v int")
    out = progress.folded_status(rows, "k", [("blocked", F.col("v") > 8), ("review", F.col("v") > 4)], "ready")
    assert got(out, "k", "cases", "status") == [("a", 2, "blocked"), ("b", 1, "review"), ("c", 1, "ready")]


def test_changes_reach_what_refers_to_them(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(10, 1), (11, 1), (12, 3)], "id int, a int")
    c = spark.createDataFrame([(100, 10), (101, 12), (102, None)], "id int, b int")
    assert got(progress.propagated(a, (b, "a", "id"), (c, "b", "id")), "id") == [(100,)]
    assert progress.propagated(a.limit(0), (b, "a", "id"), (c, "b", "id")).count() == 0


def test_runs_links_and_flows(spark):
    runs = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-03 00:00:00"), ("b", "2024-01-01 00:00:00")], "r string, at string").withColumn("at", F.to_timestamp("at"))
    assert got(progress.recovered_runs(runs, "r", "at", "2024-01-02"), "r", "state") == [("a", "running"), ("b", "recovered")]
    pages = spark.createDataFrame([(1, "x=1 x=2"), (2, None)], "i int, t string")
    assert got(progress.matched_parts(pages, "i", "t", r"x=(\d)", "found"), "i", "n_found", "found") == [(1, 2, ["1", "2"]), (2, 0, [])]
    steps = spark.createDataFrame([("f", True, "e2", True), ("f", False, "e1", True), ("g", True, "e1", None)], "f string, ok boolean, e string, usable boolean")
    assert got(progress.scenario_evidence(steps, "f", F.col("ok"), "e", F.col("usable")), "f", "passed", "steps", "evidence") == [("f", False, 2, ["e1", "e2"])]
