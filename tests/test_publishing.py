from tessera.operators import publishing


def test_builds_replace_each_other_whole(spark, tmp_path):
    first = spark.createDataFrame([(1, "a")], "k long, v string")
    second = spark.createDataFrame([(1, "b"), (2, None)], "k long, v string")
    folder = str(tmp_path / "facts")
    publishing.publish_build(first, folder)
    build = publishing.publish_build(second, folder)
    assert len(build) == 32
    assert {tuple(r) for r in publishing.current_build(spark, folder).collect()} == {(1, "b"), (2, None)}


def test_conflicts_are_never_stored(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, d string")
    incoming = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("e", "5"), ("e", "6"), ("a", "1")], "k string, d string")
    got = {r["k"]: r["action"] for r in publishing.publish_plan(stored, incoming, "k", "d").collect()}
    assert got == {"a": "replay", "b": "conflict", "c": "insert", "e": "conflict"}


def test_digest_keeps_nulls_apart(spark):
    frame = spark.createDataFrame([(None, "x"), ("x", None)], "a string, b string")
    digests = [r[0] for r in frame.select(publishing.content_digest("b", "a")).collect()]
    assert len(set(digests)) == 2
