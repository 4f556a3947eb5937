import __spark_entry__ as entry


def test_registered_names_fit():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert len(known) >= 45


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows[0]["score"] == 1.0
