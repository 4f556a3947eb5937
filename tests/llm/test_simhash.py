import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as sh
from tessera.operators import storage


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_groups(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def corpus(rng):
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    texts = [None, "", "\t", "One", "one", "two words"] + base
    for t in base:
        for _ in range(rng.randrange(4)):
            words = t.split()
            words[rng.randrange(len(words))] = rng.choice("xyz")
            texts.append(" ".join(words))
    return texts + base[:5]


def test_fingerprints():
    for t in corpus(random.Random(1)):
        assert sh.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def groups_of(spark, rows):
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    return [(r["id"], r["component_id"]) for r in sh.near_duplicate_groups(frame).collect()]


@pytest.mark.parametrize("most_hot", [1, storage.MOST_HOT, 10**9])
def test_groups_agree_with_brute_force(spark, monkeypatch, most_hot):
    """Keys of joins are all shuffled, some broadcast, all broadcast."""
    monkeypatch.setattr(storage, "MOST_HOT", most_hot)
    texts = corpus(random.Random(2))
    ids = random.Random(3).sample(range(10_000), len(texts))
    roots = slow_groups([slow_fingerprint(t) for t in texts])
    least = {r: min(ids[i] for i in range(len(ids)) if roots[i] == r) for r in roots}
    assert sorted(groups_of(spark, zip(ids, texts))) == sorted((ids[i], least[roots[i]]) for i in range(len(ids)))


def test_dense_lists_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) for c in centre for n in rng.integers(1, 6, 80)])
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = slow_groups([int(x) for x in fps])
    n_groups = len(set(want))
    for dense in (2, 24, 10_000):
        groups = {r["node"]: r["component"] for r in sh.connected_components(sh.near_links(nodes, dense)).collect()}
        got = [groups.get(x, x) for x in fps.view(np.int64).tolist()]
        assert len(set(got)) == n_groups
        assert len(set(zip(got, want))) == n_groups


def test_spanning_links_on_both_ways(monkeypatch):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 9, 120, dtype=np.uint64) | np.uint64(0xABCDEF << 40))
    want = len(set(slow_groups([int(x) for x in fps])))
    for most in (2048, 3):
        monkeypatch.setattr(sh, "PAIRWISE", most)
        u, v = sh.spanning_links(fps)
        assert len(u) == len(fps) - want
        assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in zip(u, v))


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (7, "other text altogether here"), (7, "other text altogether here"), (None, "alone with no id at all"), (9, None), (8, "")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, group_fp string")
    kept = sh.keep_one_of_each_group(frame)
    assert kept.columns == frame.columns
    got = sorted(((r["doc_id"] or -1), r["text"]) for r in kept.collect())
    assert got == [(-1, "alone with no id at all"), (2, "a b c d"), (7, "other text altogether here"), (8, "")]
    assert sh.keep_one_of_each_group(frame.limit(0)).count() == 0


def test_long_texts_and_thousands_of_equal_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(7, words)] * 3000 + [(8, f"{words} w60"), (9, "other " * 300_000), (10, None), (11, "")]
    got = {(r["id"], r["component_id"]) for r in sh.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(7, 7), (9, 9), (10, 10), (11, 10)} <= got and len(got) == 5
