import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
        return shuffled_rows(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_bins_cover_an_interval_once(spark):
    rng = random.Random(5)
    pairs = [(s, s + rng.choice([0, 1, 2, 3, 7, 8, 100, 1000])) for s in [*range(-20, 60), *(rng.randrange(-5000, 5000) for _ in range(200))]]
    for powers in (12, 3, 0):
        rows = spark.createDataFrame(pairs, "s long, e long").select("s", "e", intervals.dyadic_bins(F.col("s"), F.col("e"), powers).alias("b")).collect()
        for r in rows:
            covered = sorted(x for b in r["b"] for x in range(b["at"] << b["power"], (b["at"] + 1) << b["power"]))
            assert covered == list(range(r["s"], r["e"] + 1)), (r["s"], r["e"], powers)
            if powers == 12:
                assert len(r["b"]) <= 2 * (r["e"] - r["s"] + 1).bit_length()


def test_parents_agree_with_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), i, s, s + rng.choice([0, 1, 3, 10, 50, 400]), "x") for i, s in enumerate(rng.randrange(-300, 300) for _ in range(300))]
    rows += [(0, 900, 5, 2, "x"), (None, 901, 1, 5, "x"), (1, 902, None, 5, "x"), (2, 903, -10**12, 10**12, "x"), (3, 904, 7, 7, "x"), (3, 905, 7, 7, "x")]
    want = {}
    for k, i, s, e, _ in rows:
        holders = [(e2 - s2, i2) for k2, i2, s2, e2, _ in rows if None not in (k, s, s2) and k2 == k and s2 <= s and e <= e2 and e2 - s2 > e - s and s <= e]
        least = [h for n, h in holders if n == min(holders)[0]]
        want[i] = (least[0] if len(least) == 1 else None, len(least), len(holders))
    frame = spark.createDataFrame(rows, "k long, i long, a long, b long, bin string")
    got = {r["id"]: (r["parent"], r["parents"], r["holders"]) for r in intervals.nested_intervals(frame, "k", "a", "b", "i").collect()}
    assert got == want and max(w[2] for w in want.values()) > 5
    assert intervals.nested_intervals(frame.limit(0), "k", "a", "b", "i").count() == 0


@pytest.mark.parametrize(("one_long_in", "most_close"), [(1000, 0), (10, 200), (10, 0), (3, 20)])
def test_areas_and_bins_agree_with_brute_force(spark, monkeypatch, one_long_in, most_close):
    """Also where long intervals go over many areas, and where rows are there twice."""
    monkeypatch.setattr(intervals, "ONE_LONG_IN", one_long_in)
    monkeypatch.setattr(intervals, "MOST_CLOSE", most_close)
    rng = random.Random(7)
    rows = [(rng.randrange(3), i, s, s + rng.choice([0, 1, 2, 5, 9, 300 if i % 9 == 0 else 3])) for i, s in enumerate(rng.randrange(-200, 200) for _ in range(400))]
    rows += rows[:40] + [(None, 900, 1, 2), (1, 901, 5, 2), (2, 902, -10**12, 10**12)]
    want = []
    for k, i, s, e in rows:
        holders = [(e2 - s2, i2) for k2, i2, s2, e2 in rows if k is not None and k2 == k and s2 <= s and e <= e2 and e2 - s2 > e - s and s <= e]
        least = [h for n, h in holders if n == min(holders)[0]]
        want.append((k, i, least[0] if len(least) == 1 else None, len(least), len(holders)))
    frame = spark.createDataFrame(rows, "k long, i long, a long, b long")
    got = [tuple(r) for r in intervals.nested_intervals(frame, "k", "a", "b", "i").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_intervals_are_shuffled_once(spark):
    """Two rows an interval at most, where bins and pairs took tens."""
    rows = [(i % 3, i, i, i + i % 90) for i in range(3000)]
    out = intervals.nested_intervals(spark.createDataFrame(rows, "k long, i long, a long, b long"), "k", "a", "b", "i")
    assert len(out.collect()) == 3000
    assert 0 < shuffled_rows(out._jdf.queryExecution().executedPlan()) <= 4 * len(rows)  # an exchange that is read twice counts twice


def test_lambdas_in_their_callable(spark):
    methods = spark.createDataFrame([("m1", "a", 1, 20), ("m2", "a", 5, 9), ("m3", "b", 1, 20), ("m4", "a", 30, 31), ("m5", "a", 30, 31)], "method_id string, path string, line int, end_line int")
    lambdas = spark.createDataFrame([("x", "a", 6, 6), ("y", "a", 10, 12), ("z", "a", 5, 9), ("v", "a", 19, 22), ("w", "a", 30, 30), ("u", "c", 1, 1)], "lambda_id string, path string, line int, end_line int")
    got = {r["lambda_id"]: (r["method_id"], r["candidates"]) for r in intervals.enclosing_callables(lambdas, methods).collect()}
    assert got == {"x": ("m2", 1), "y": ("m1", 1), "z": ("m2", 1), "v": (None, 0), "w": (None, 2), "u": (None, 0)}
