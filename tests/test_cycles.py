import random

from pyspark.sql import functions as F

from tessera.operators import cycles, reduction


def brute(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {d for s, d in edges if s == n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for n in nodes:
            more = set().union(*(reach[m] for m in reach[n])) - reach[n] if reach[n] else set()
            if more:
                reach[n] |= more
                grown = True
    out = {}
    for n in nodes:
        if n in reach[n]:
            members = {m for m in nodes if m in reach[n] and n in reach[m]}
            out[n] = (min(members), len(members))
    return out


def test_cycles_agree_with_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(40)] + [(50, 51), (51, 52), (52, 50), (60, 60), (52, 61), (61, 62)]
    frame = spark.createDataFrame([*edges, *edges[:5], (None, 3), (3, None)], "src long, dst long")
    got = {r["node"]: (r["component"], r["size"]) for r in cycles.cycle_members(frame).collect()}
    want = brute(edges)
    assert got == want and 60 in want and {s for _, s in want.values()} > {1, 3}
    assert cycles.cycle_members(frame.limit(0)).count() == 0


def test_order_by_levels_and_names(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdefgxyz"], "node string")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", "a"), ("e", "g"), ("x", "y"), ("y", "x"), ("z", "x")], "node string, needs string")
    rows = cycles.topological_order(nodes, edges).collect()
    assert [r["node"] for r in sorted((r for r in rows if r["place"]), key=lambda r: r["place"])] == ["c", "f", "g", "a", "b", "e", "d"]
    assert {r["node"] for r in rows if r["place"] is None} == {"x", "y", "z"}


def test_reduction_leaves_what_takes_part(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "root": make([(i, i % 7, i % 5) for i in range(70)] + [(99, None, 1)], "id int, a int, b int"),
        "left": make([(0, "x"), (1, "y"), (8, "z"), (1, "w")], "a int, p string"), "right": make([(b, b * 10) for b in range(4)], "b int, c int"),
        "far": make([(10, True), (20, False), (20, True), (70, True)], "c int, q boolean"),
    }
    tree = [("left", "root", ["a"]), ("right", "root", ["b"]), ("far", "right", ["c"])]
    left = {k: v.collect() for k, v in reduction.reduced(tables, tree).items()}
    rows = reduction.joined(tables, tree).collect()
    for name, kept in left.items():
        columns = tables[name].columns
        assert {tuple(r[c] for c in columns) for r in kept} == {tuple(r[c] for c in columns) for r in rows}
    plain = tables["root"].join(tables["left"], "a").join(tables["right"], "b").join(tables["far"], "c")
    assert sorted(map(str, rows)) == sorted(map(str, plain.select(*rows[0].__fields__).collect())) and len(rows) > 10
    assert reduction.joined({**tables, "far": tables["far"].filter(F.lit(False))}, tree).count() == 0


def test_rescan_equals_a_full_scan(spark):
    from tessera.operators import graph

    old = spark.createDataFrame([(i, i % 5) for i in range(30)], "k long, d int")
    new = spark.createDataFrame([(i, 9 if i in (2, 20) else i % 5) for i in range(33) if i not in (4, 29)], "k long, d int")
    links = spark.createDataFrame([(i, i // 2) for i in range(1, 33)] + [(1, 0), (3, 3)], "k long, uses long")

    def over(files):
        def scan(rows):
            used = files.select(F.col("k").alias("uses"), F.col("d").alias("u"))
            return rows.join(links.join(used, "uses", "left").groupBy("k").agg(F.sum("u").alias("s")), "k", "left").select("k", "d", "s")
        return scan

    rows = graph.incremental_rescan(over(old)(old), old, new, links, "k", "d", over(new)).collect()
    assert {(r["k"], r["d"], r["s"]) for r in rows} == {tuple(r) for r in over(new)(new).collect()} and len(rows) == 31
    again = {r["k"] for r in rows if r["rescanned"]}
    reach = {2, 20, 4, 29, 30, 31, 32}
    while True:
        more = {i for i in range(33) if i // 2 in reach} | reach
        if more == reach:
            break
        reach = more
    assert again == reach - {4, 29} and not again >= {0, 1, 3}
