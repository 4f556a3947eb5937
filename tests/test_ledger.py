import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def status(book):
    return {r["build"]: (r["current"], r["status"]) for r in book.status().collect()}


def test_one_build_is_current_and_dependants_go_stale(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    assert book.current("relations", "s1") is None
    assert book.publish("r1", "relations", "s1", rows(spark, (1, "a"), (2, None))) == "created"
    assert book.publish("i1", "index", "s1", rows(spark, (1, "x"), (2, "y")), ["r1"], wanted=rows(spark, (1, ""), (2, ""), (1, ""))) == "created"
    assert book.publish("g1", "graph", "s1", rows(spark), ["i1"]) == "created"
    assert book.publish("r9", "relations", "s2", rows(spark, (1, "a"))) == "created"
    assert set(status(book).values()) == {(True, "ready")}
    assert book.publish("r2", "relations", "s1", rows(spark, (1, "b"))) == "created"
    assert status(book) == {"r1": (False, "stale"), "i1": (True, "stale"), "g1": (True, "stale"), "r9": (True, "ready"), "r2": (True, "ready")}
    assert [tuple(r) for r in book.current("relations", "s1").collect()] == [(1, "b")] and book.current("index", "s1") is None
    # a replay, in whatever order, does nothing and wakes nothing
    assert book.publish("r1", "relations", "s1", rows(spark, (2, None), (1, "a"))) == "replayed"
    assert status(book)["r1"] == (False, "stale") and book.events().count() == 5 and book.intact("r1")


def test_what_is_refused_leaves_the_ledger_as_it_was(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    book.publish("b1", "index", "s", rows(spark, (1, "a"), (1, "a")))
    for change in (lambda: book.publish("b1", "index", "s", rows(spark, (1, "a"))), lambda: book.publish("b1", "index", "other", rows(spark, (1, "a"), (1, "a")))):
        with pytest.raises(ledger.Conflict, match="other content"):
            change()
    with pytest.raises(ledger.Conflict, match="2 keys"):
        book.publish("b2", "index", "s", rows(spark, (1, "a"), (None, "b")), wanted=rows(spark, (1, ""), (2, ""), (3, "")))
    with pytest.raises(ledger.Conflict, match="aren't known"):
        book.publish("b2", "index", "s", rows(spark), ["b1", "nothing"])
    with pytest.raises(ledger.Conflict, match="is at 1"):
        book.publish("b2", "index", "s", rows(spark), expected=0)
    broken = rows(spark, (5, "x")).withColumn("v", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):  # a task that fails
        book.publish("b2", "index", "s", broken)
    assert status(book) == {"b1": (True, "ready")} and [tuple(r) for r in book.current("index", "s").distinct().collect()] == [(1, "a")]


def test_a_publisher_that_is_overtaken_fails(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    book.publish("b1", "index", "s", rows(spark, (1, "a")))
    before = book.events()
    before = spark.createDataFrame(before.collect(), ledger.EVENTS)
    book.publish("b2", "index", "s", rows(spark, (2, "b")))
    monkeypatch.setattr(book, "events", lambda: before)
    with pytest.raises(ledger.Conflict, match="meanwhile"):
        book.publish("b3", "index", "s", rows(spark, (3, "c")))
    monkeypatch.undo()
    assert [tuple(r) for r in book.current("index", "s").collect()] == [(2, "b")]
