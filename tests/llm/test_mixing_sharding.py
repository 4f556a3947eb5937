import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mixing, sharding


def brute_targets(sizes):
    """Sizes by source to targets: excess is reshared by weight until no source is above twice its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] >= 2 * sizes[s]}
        if not over:
            return target
        full |= over
        left -= sum(2 * sizes[s] for s in over)
        if len(full) == len(order):
            return {s: 2 * sizes[s] for s in order}


def rows(seed=1, n=600):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "hot", "hot", "hot", "tiny"]
    out = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(120))), rng.choice(names)) for i in range(n)]
    return out + [(n, None, "a"), (n + 1, "", "empty"), (None, "no id here", "a"), (3, "same id", "b")] + out[:4]


@pytest.fixture(scope="module")
def mix(spark):
    frame = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows()], "doc_id long, text string, source string, size int")
    return frame, mixing.pareto_mix(frame).toPandas()


def test_targets_and_takes(mix):
    _, got = mix
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows():
        sizes[s] += size(t)
    want = brute_targets(sizes)
    assert len(got) == len(rows())
    by_size = {(v, round(want[s], 6)) for s, v in sizes.items()}
    assert {(a, round(b, 6)) for a, b in zip(got["source_size"], got["target"])} == by_size
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    taken = got.groupby("source_size")["taken"].sum()
    for s, v in sizes.items():
        assert abs(taken[v] - want[s]) <= 60  # half the largest document


def test_reruns_agree_and_rows_follow_copies(spark, mix):
    frame, got = mix
    again = mixing.pareto_mix(frame.repartition(7)).toPandas()
    key = lambda f: Counter(zip(f["h"], f["copies"]))
    assert key(got) == key(again)
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == got["copies"].sum()
    assert mixing.mixed_documents(frame.limit(0)).count() == 0


def test_size_raises_the_chance(spark):
    """Of two kinds of documents in one source, the longer is taken more often than the shorter."""
    frame = spark.createDataFrame([(i, "w " * (400 if i % 2 else 5), "s") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.pareto_mix(frame, share=0.5).toPandas()
    assert got[got["size"] == 400]["copies"].mean() > 4 * got[got["size"] == 5]["copies"].mean()


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation_is_one(total):
    out = sharding.permute(np.arange(total), total)
    assert sorted(out.tolist()) == list(range(total))
    if total > 60:
        assert (out != np.arange(total)).sum() > total * 0.9


def test_shards_are_even_and_reproducible(spark):
    data = rows()
    frame = spark.createDataFrame([(i, t, 1) for i, t, _ in data], "doc_id long, text string, shard int")
    out = sharding.shard_rows(frame).toPandas()
    again = sharding.shard_rows(frame.repartition(5)).toPandas()
    columns = ["id", "size", "text_crc32", "shard", "slot"]
    as_set = lambda f: Counter(tuple(r) for r in f[columns].fillna(-1).itertuples(index=False))
    assert as_set(out) == as_set(again)
    want = Counter((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in data)
    assert Counter(zip(out["id"].fillna(-1).astype(int), out["size"], out["text_crc32"])) == want
    counts = out.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(counts) == 24 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    shard, slot = sharding.locate(out["row_number"].to_numpy(), len(out))
    assert (shard == out["shard"]).all() and (slot == out["slot"]).all()
    assert sharding.shard_rows(frame.limit(0)).count() == 0


def test_the_drawn_sample_agrees_with_brute_force(spark):
    """Ranks, their order and where each source's sample ends, from the hashes alone."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 120)), rng.choice(["a", "b", "b", "b", None])) for i in range(500)] + [(1000, "long " * 30_000, "a"), (None, "x y", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sized(frame).collect()
    out = {r["h"]: r for r in mixing.pareto_mix(frame).collect()}
    by_source = {}
    for r in sized:
        by_source.setdefault((r["no_source"], r["source_name"]), []).append(r)
    for own in by_source.values():
        total, target = sum(r["size"] for r in own), out[own[0]["h"]]["target"]
        whole = int(target / total + 1e-9)
        rest = max(target - whole * total, 0.0)
        like = lambda n: n / (n + 50.0)
        liked = sum(int(like(r["size"]) * r["size"] * 1e6) for r in own) / 1e6
        ranked = []
        for r in own:
            p = min(max(rest / liked * like(r["size"]), 1e-9), 1 - 1e-9)
            rank = r["u"] / (1 - r["u"]) / (p / (1 - p))
            ranked.append((rank, r["h"], r["size"]))
        upto = 0
        for _, h, size in sorted(ranked):
            before, upto = upto, upto + size
            drawn = upto <= rest or (before < rest and upto - rest < rest - before)
            assert out[h]["copies"] == whole + drawn and out[h]["taken"] == out[h]["copies"] * size


def test_numbers_are_permuted_as_a_plain_network_does(spark):
    def mixed(x, key):
        x = (x + key) % 2**64
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
        return x ^ (x >> 31)

    def permuted(x, total):
        bits = next(b for b in range(1, 40) if 4**b >= total)
        while True:
            left, right = x >> bits, x & (2**bits - 1)
            for r in range(sharding.ROUNDS):
                key = (sharding.SEED * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64
                left, right = right, left ^ (mixed(right, key) % 2**bits)
            x = left << bits | right
            if x < total:
                return x

    rows = [(i, "t" * (i % 40)) for i in range(700)] + [(3, "ttt")] * 5 + [(None, None)] * 2
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["row_number"] for r in out) == list(range(len(rows)))
    for r in out:
        to = permuted(r["row_number"], len(rows))
        assert (r["shard"], r["slot"]) == (to % sharding.SHARDS, to // sharding.SHARDS)
